"""Exact Jaccard join of word n-gram sets with prefix trees, and its groups.

1. Each task cuts texts into sets of hashed n-grams and sends a set once for all copies it has met. What it sends are
   postings in compact blocks, by ranges of the hash.
2. Where postings meet, n-grams of a single distinct set drop out: they only count in that set's size. The others get
   their document frequency and go back to their sets.
3. In the global order (frequency, hash) two sets that link share one of each other's first n-grams: of n, the first
   n - ceil(t n) + 1. Sets whose n-grams outside all other sets are more than that have no partner and drop out.
4. Sets that share such an n-gram are inserted in a prefix tree and searched in it. A first round takes two n-grams of
   each set; its links are contracted to components. The second takes all, for n-grams whose sets lie in several
   components, and looks only for links between different components. Large groups are cut in blocks: in the first
   round every block also has the same few leaders; in the second every block meets every other one that it may have
   links with, two at a time. So every link between components is found, and no group meets in one task.

Returned are the number of n-grams and the component of each document, links themselves stay inside the tasks. No link
is left out; n-grams are compared by 48 bits of a hash beside its range (of ``FINE`` times as many ranges as shuffle
partitions) and sets by 64 bits, so that among m distinct n-grams about m * m / (2 ** 49 * ranges) pairs, and among s
distinct sets about s * s / 2 ** 65, can't be told apart.

Tasks hold the packed blocks of one part and unpack a ``FINE``-th of it at a time, or hold one group of at most two
blocks.

Null, empty and blank texts have no n-gram and link with nothing. Texts of fewer than n words are one n-gram. Copies,
repeated rows and ties are in one component, named by its smallest id; a null id is never the smallest unless alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import cleared, drop, shuffle_partitions, stable, tidy
from ringside.llm.components import connected_components
from ringside.llm.prefix_tree import Forest, PrefixTree

NO_ID = np.iinfo(np.int64).min  # stands for a null id inside blocks
LOW = 48
CACHE_BYTES, CACHE_KEYS, CHUNK = 16_000_000, 200_000, 1_000_000
FINE = 2
BLOCK, LEADERS = 256, 16
BLOCKS = "part int, kind string, keys array<binary>, counts array<binary>, tokens array<binary>"
BLOCK_NAMES = ["part", "kind", "keys", "counts", "tokens"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    def __init__(self, words: int) -> None:
        self.words, self.seen, self.bytes = words, {}, 0

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct n-gram hashes of a text; A-Z in lower case, words between ASCII white space."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        if self.bytes > CACHE_BYTES:
            self.seen, self.bytes = {}, 0
        seen = self.seen
        for w in words:
            if w not in seen:
                seen[w] = xxhash.xxh3_64_intdigest(w)
                self.bytes += 170 + len(w)
        h = np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))
        k = self.words
        if len(h) < k:
            return mix(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64))
        out = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        return np.unique(mix(out))


def _pack(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LOW // 8].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) * 8 // LOW, 8), dtype=np.uint8)
    wide[:, : LOW // 8] = np.frombuffer(data, dtype=np.uint8).reshape(-1, LOW // 8)
    return wide.view("<u8").ravel().astype(np.int64)


def _by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), [c[order[a:b]] for c in columns]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.diff(np.append(starts, len(keys))).astype("<u4")


def _of_key(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(ranges)).astype(np.int64)


def _rows(kind: str, pieces: Iterator[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple]:
    """One row a part from pieces (range, keys, counts, tokens): a part is FINE ranges in a row."""
    out: dict[int, list[list[bytes]]] = {}
    for at, *piece in pieces:
        row = out.setdefault(at // FINE, [[b""] * FINE for _ in range(3)])
        for column, x in zip(row, piece, strict=True):
            column[at % FINE] = x
    for part, row in out.items():
        yield part, kind, *row


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=BLOCK_NAMES)


def _postings(words: int, parts: int):
    """Blocks of postings by hash range, of (key, size) by key, and of (id, key, size) by id."""
    ranges = parts * FINE

    def chunk(ids: list[int], keys: list[int], sizes: list[int], fresh: list[tuple[int, np.ndarray]]) -> Iterator[tuple]:
        i, k, n = (np.array(x, dtype=np.int64) for x in (ids, keys, sizes))
        yield from _rows("doc", ((p, b.tobytes(), c.tobytes(), a.tobytes()) for p, (a, b, c) in _by_part(_of_key(i, ranges), i, k, n)))
        if fresh:
            k = np.array([x[0] for x in fresh], dtype=np.int64)
            n = np.array([len(x[1]) for x in fresh], dtype=np.int64)
            yield from _rows("size", ((p, b.tobytes(), c.tobytes(), b"") for p, (b, c) in _by_part(_of_key(k, ranges), k, n)))
            tokens = np.concatenate([x[1] for x in fresh])
            at = ((tokens >> np.uint64(LOW)) * np.uint64(ranges) >> np.uint64(64 - LOW)).astype(np.int64)
            pieces = ((p, a, *_runs(b)) for p, (a, b) in _by_part(at, tokens, np.repeat(k, n)))
            yield from _rows("post", ((p, one.tobytes(), count.tobytes(), _pack(a)) for p, a, one, count in pieces))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, met = Shingler(words), set()
        ids, keys, sizes, fresh, total = [], [], [], [], 0
        for b in batches:
            for i, text in zip(b["id"].tolist(), b["text"], strict=True):
                tokens = cut(text)
                key = int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True) if len(tokens) else 0
                ids.append(i)
                keys.append(key)
                sizes.append(len(tokens))
                if len(tokens) and key not in met:
                    if len(met) >= CACHE_KEYS:
                        met.clear()
                    met.add(key)
                    fresh.append((key, tokens))
                    total += len(tokens)
                if total >= CHUNK or len(ids) >= 50_000:
                    yield _frame(list(chunk(ids, keys, sizes, fresh)))
                    ids, keys, sizes, fresh, total = [], [], [], [], 0
        if ids:
            yield _frame(list(chunk(ids, keys, sizes, fresh)))

    return run


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple]]]:
    """(part, its rows of kind, keys, counts, tokens), from batches that are sorted by part."""
    now, rows = None, []
    for b in batches:
        for p, *row in b[BLOCK_NAMES].itertuples(index=False):
            if p != now:
                if rows:
                    yield now, rows
                now, rows = p, []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _shared(parts: int):
    """Postings of hash ranges to n-grams in two sets or more, sent on by key."""

    def solve(at: int, rows: list[tuple[bytes, bytes, bytes]]) -> tuple[np.ndarray, ...]:
        """(keys, tokens, frequencies) of one range."""
        keys = np.concatenate([np.repeat(np.frombuffer(k, dtype=np.int64), np.frombuffer(c, dtype="<u4")) for k, c, _ in rows])
        tokens = np.concatenate([_unpack(t) for _, _, t in rows])
        order = np.argsort(tokens, kind="stable")
        keys, tokens = keys[order], tokens[order]
        again = np.zeros(len(tokens), dtype=bool)
        again[1:] = tokens[1:] == tokens[:-1]
        twice = again.copy()
        twice[:-1] |= again[1:]
        keys, tokens = keys[twice], tokens[twice]
        if not len(tokens):
            return keys, tokens, tokens.astype("<u4")
        order = np.lexsort((keys, tokens))
        keys, tokens = keys[order], tokens[order]
        new = np.ones(len(tokens), dtype=bool)  # the same set may come from several tasks
        new[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        keys, tokens = keys[new], tokens[new]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        n = np.diff(np.append(starts, len(tokens)))
        df = np.repeat(n, n)
        keep = df >= 2
        return keys[keep], tokens[keep] | (at << LOW), df[keep].astype("<u4")

    def sent(found: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        keys, tokens, df = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, tokens, df = keys[order], tokens[order], df[order]
        for q, (k, t, d) in _by_part(_of_key(keys, parts * FINE), keys, tokens, df):
            one, count = _runs(k)
            yield q, one.tobytes(), count.tobytes(), t.tobytes() + d.tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p, rows in _parts(batches):
            out = [(p, *r) for r in rows if r[0] != "post"]
            posts = [r[1:] for r in rows if r[0] == "post"]
            del rows
            found = []
            for f in range(FINE):
                pieces = [(k[f], c[f], t[f]) for k, c, t in posts if len(k[f])]
                if pieces:
                    found.append(solve(p * FINE + f, pieces))
            del posts
            if found:
                out += _rows("set", sent(found))
            if out:
                yield _frame(out)

    return run


SETS = "id long, key long, size int, lead int, tokens array<long>, dfs array<int>"


def _assemble(num: int, den: int):
    """Rows of documents (id, key, size), and of sets that may have a partner (key, size, lead, tokens, dfs): lead is
    how many of the shared n-grams, rarest first, can be the first common one."""

    names = ["id", "key", "size", "lead", "tokens", "dfs"]

    def solve(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        size: dict[int, int] = {}
        sets: list[tuple] = []
        for kind, k, c, t in rows:
            keys = np.frombuffer(k, dtype=np.int64)
            if not len(keys):
                continue
            if kind == "doc":
                n, ids = np.frombuffer(c, dtype=np.int64), np.frombuffer(t, dtype=np.int64)
                yield pd.DataFrame({"id": ids, "key": keys, "size": n.astype(np.int32), "lead": np.zeros(len(ids), dtype=np.int32), "tokens": None, "dfs": None})
            elif kind == "size":
                size |= zip(keys.tolist(), np.frombuffer(c, dtype=np.int64).tolist(), strict=True)
            else:
                count = np.frombuffer(c, dtype="<u4")
                n = int(count.sum())
                sets.append((np.repeat(keys, count), np.frombuffer(t[: 8 * n], dtype=np.int64), np.frombuffer(t[8 * n :], dtype="<u4")))
        if not sets:
            return
        keys, tokens, dfs = (np.concatenate(x) for x in zip(*sets, strict=True))
        sets.clear()
        order = np.lexsort((tokens, dfs, keys))
        keys, tokens, dfs = keys[order], tokens[order], dfs[order]
        one, count = _runs(keys)
        ends = np.cumsum(count.astype(np.int64))
        out, held = [], 0
        for k, m, e in zip(one.tolist(), count.tolist(), ends.tolist(), strict=True):
            n = size[k]
            lead = n - -(-num * n // den) + 1 - (n - m)
            if lead > 0:
                out.append((NO_ID, k, n, min(lead, m), tokens[e - m : e], dfs[e - m : e].astype(np.int32)))
                held += m
            if held >= CHUNK // 2:
                yield pd.DataFrame(out, columns=names)
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _parts(batches):
            for f in range(FINE):
                yield from solve([(kind, k[f], c[f], t[f]) for kind, k, c, t in rows])

    return run


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by group."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        cuts = np.flatnonzero(np.diff(b["group"].to_numpy())) + 1
        pieces = [b.iloc[x:y] for x, y in zip([0, *cuts], [*cuts, len(b)], strict=True)]
        for piece in pieces:
            if rest and rest[0]["group"].iloc[0] != piece["group"].iloc[0]:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(piece)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def _search(num: int, den: int):
    """Links of each group, as a forest of edges (a, b) between keys. Rows with probe search the tree of the rows with
    held for sets of another component."""

    def solve(g: pd.DataFrame) -> list[tuple[int, int]]:
        g = g.drop_duplicates("key")
        keys, comps = g["key"].tolist(), g["component"].tolist()
        flat, dfs = np.concatenate(g["tokens"].tolist()), np.concatenate(g["dfs"].tolist())
        order = np.lexsort((flat, dfs))
        first = np.ones(len(order), dtype=bool)
        first[1:] = flat[order][1:] != flat[order][:-1]
        local = np.empty(len(order), dtype=np.int64)
        local[order] = np.cumsum(first) - 1  # the same frequency comes with a token everywhere
        cuts = np.cumsum([0, *map(len, g["tokens"])])
        sets = [np.sort(local[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        label = {c: k for k, c in enumerate(dict.fromkeys(comps))}
        labels = [label[c] for c in comps]
        sizes, held = g["size"].tolist(), np.flatnonzero(g["held"].to_numpy()).tolist()
        tree = PrefixTree([sets[k] for k in held], [sizes[k] for k in held], [labels[k] for k in held])
        forest = Forest(len(sets))
        ends = {}
        for k, c in enumerate(labels):
            forest.join(ends.setdefault(c, k), k)
        out = []
        probes = np.flatnonzero(g["probe"].to_numpy())
        mutual = len(probes) == len(held) == len(sets)  # then each pair needs one look only
        for k in probes.tolist():
            if forest.parts == 1:
                break
            for j in tree.linked(sets[k], sizes[k], labels[k], num, den, k if mutual else -1):
                if forest.join(k, held[j]):
                    out.append((keys[k], keys[held[j]]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches):
            edges = solve(g)
            if edges:
                yield pd.DataFrame(edges, columns=["a", "b"])

    return run


def _links(members: DataFrame, sets: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """members: groups (rows: array of key, component, probe, held); the same group is searched once."""
    groups = members.filter(F.size("rows") > 1).select(F.xxhash64("rows").alias("group"), "rows").dropDuplicates(["group"])
    rows = groups.select("group", F.explode("rows").alias("r")).select("group", "r.*").join(sets.select("key", "size", "tokens", "dfs"), "key")
    return rows.repartition(parts, "group").sortWithinPartitions("group").mapInPandas(tidy(_search(num, den)), "a long, b long")


def _meetings(every: DataFrame, num: int, den: int) -> DataFrame:
    """Groups of the second round from rows (token, key, component, size, reach): reach counts a set's shared n-grams
    from this one on, so two sets that have it as their first common one share as many as the smaller reach at most.

    An n-gram of up to BLOCK sets is one group. Others are cut in blocks of about BLOCK sets: components of BLOCK sets or
    more have blocks of their own; if more than BLOCK sets are left, blocks are also cut by size, and sets that can only
    link with smaller ones (short) are apart, as two of them never link. A group is a pair of blocks, or one block,
    without those whose bounds or single component leave no link to find.
    """
    each = every.groupBy("token", "component").agg(F.count("*").alias("n"))
    spread = each.groupBy("token").agg(F.sum("n").alias("m"), F.sum(F.when(F.col("n") < BLOCK, F.col("n")).otherwise(0)).alias("rest"), F.count("*").alias("c")).filter("c > 1")
    rows = F.sort_array(F.collect_list(F.struct("key", "component", "probe", "held"))).alias("rows")
    whole = every.join(spread.filter(F.col("m") <= BLOCK), "token").withColumns({"probe": F.lit(True), "held": F.lit(True)}).groupBy("token").agg(rows).select("rows")

    homes = each.filter(F.col("n") >= BLOCK).select("token", "component", F.lit(True).alias("large"))
    fine = F.col("rest") > BLOCK
    hot = (
        every.join(spread.filter(F.col("m") > BLOCK).select("token", "rest"), "token").join(homes, ["token", "component"], "left")
        .withColumn("home", F.when(F.col("large"), F.col("component")))
        .withColumn("grade", F.when(fine, F.floor(F.log("size") / F.log(F.lit(1.05)))).otherwise(0).cast("int"))
        .withColumn("short", fine & ((num + den) * F.col("reach") < 2 * num * F.col("size")))
        .withColumn("deck", F.xxhash64("home", "grade", "short"))
    )
    decks = hot.groupBy("token", "deck").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    part = F.pmod(F.xxhash64("key"), F.col("many")).cast("int")
    hot = stable(hot.join(decks, ["token", "deck"]).select("token", "key", "component", "size", "reach", "short", F.xxhash64("deck", part).alias("block")))
    bounds = hot.groupBy("token", "block").agg(
        F.min("size").alias("least"), F.max("size").alias("most"), F.max("reach").alias("reach"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.every("short").alias("short")
    )
    x, y = bounds.alias("x"), bounds.alias("y")
    pairs = x.join(y, "token").filter(
        f"""x.block <= y.block and not (x.c0 = y.c1 and x.c1 = y.c0) and not (x.short and y.short)
        and {num + den}L * least(x.reach, y.reach) >= {num}L * (x.least + y.least)
        and {den}L * x.most >= {num}L * y.least and {den}L * y.most >= {num}L * x.least"""
    ).select("token", F.col("x.block").alias("a"), F.col("y.block").alias("b"))
    same = F.col("a") == F.col("b")
    visit = lambda block, probe, held: F.struct(block.alias("block"), probe.alias("probe"), held.alias("held"))
    yes, no = F.lit(True), F.lit(False)
    sides = F.when(same, F.array(visit(F.col("a"), yes, yes))).otherwise(F.array(visit(F.col("a"), yes, no), visit(F.col("b"), no, yes)))
    visits = pairs.select("token", "a", "b", F.explode(sides).alias("v")).select("token", "a", "b", "v.*")
    return whole.unionByName(visits.join(hot, ["token", "block"]).groupBy("token", "a", "b").agg(rows).select("rows"))


def jaccard_groups(
    docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles and component_id of each document; link: den * intersection >= num * union."""
    spark = docs.sparkSession
    out: DataFrame | None = None
    with cleared(spark, lambda: out):
        out = stable(_groups_of(docs, words, num, den, id_col, text_col))
    return out


def _groups_of(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    tasks = shuffle_partitions(docs.sparkSession)
    parts = min(tasks, (1 << (64 - LOW)) // FINE)
    narrow = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    dealt = lambda df: df.repartition(tasks, "part").sortWithinPartitions("part")
    blocks = dealt(narrow.mapInPandas(tidy(_postings(words, parts)), BLOCKS))
    back = dealt(blocks.mapInPandas(tidy(_shared(parts)), BLOCKS))
    built = stable(back.mapInPandas(tidy(_assemble(num, den)), SETS))
    rows = built.filter(F.col("tokens").isNull()).select("id", "key", "size")
    sets = built.filter(F.col("tokens").isNotNull()).select("key", "size", "lead", "tokens", "dfs")

    # first round: two n-grams of each set, the last that can be the first common one and one halfway
    some = sets.select("key", F.explode(F.array_distinct(F.array(F.element_at("tokens", F.col("lead")), F.element_at("tokens", F.floor((F.col("lead") + 1) / 2).cast("int"))))).alias("token"))
    count = some.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    many = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("key"), many).cast("int")
    leads = F.pmod(F.xxhash64("key", F.lit(5)), F.col("m")) < LEADERS
    first = (
        some.join(count, "token")
        .select("token", "key", F.explode(F.when((many > 1) & leads, F.sequence(F.lit(0), many - 1)).otherwise(F.array(block))).alias("block"))
        .groupBy("token", "block")
        .agg(F.sort_array(F.collect_list(F.struct("key", F.col("key").alias("component"), F.lit(True).alias("probe"), F.lit(True).alias("held")))).alias("rows"))
    )
    links = stable(_links(first, sets, num, den, tasks))
    found = connected_components(links)

    # second round: every n-gram that can be the first common one, if its sets lie in several components
    named = sets.join(found.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    every = named.select("key", "component", "size", F.size("tokens").alias("shared"), F.posexplode(F.slice("tokens", 1, F.col("lead"))).alias("at", "token"))
    second = _meetings(every.select("token", "key", "component", F.col("size").cast("long").alias("size"), (F.col("shared") - F.col("at")).cast("long").alias("reach")), num, den)
    more = stable(_links(second, sets, num, den, tasks))
    drop(found)
    whole = connected_components(links.unionByName(more))

    least = rows.groupBy("key").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least"))
    least = least.join(whole.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = least.join(least.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("key", "component_id")
    own = F.nullif(F.col("id"), F.lit(NO_ID))
    alone = rows.filter("size = 0").select(own.alias(id_col), F.col("size").cast("long").alias("n_shingles"), own.alias("component_id"))
    others = rows.filter("size > 0").join(named, "key")
    return others.select(own.alias(id_col), F.col("size").cast("long").alias("n_shingles"), "component_id").unionByName(alone)


def op5_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs)


OP5_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from words
), grams as (select doc_id, unnest(g) as g from sets), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from grams a join grams b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 85 * (len(x.g) + len(y.g) - n)
), reach(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a
)
select s.doc_id, len(s.g)::bigint as n_shingles, m.component_id from sets s join (select a, min(b) as component_id from reach group by a) m on m.a = s.doc_id
"""
