"""Removal of repeated passages: every byte that lies in a string of ``width`` bytes which also starts earlier.

"Earlier" is by id, then by place. The classical way sorts all suffixes by their first ``width`` bytes and compares
neighbours. Here the suffixes that can't have an equal neighbour are left out first, without any loss:

1. Anchors. Of every window (string of ``width`` bytes) the part of ``part`` bytes with the smallest hash is its anchor.
   Equal windows have equal anchors at equal offsets, so only windows with the same anchor need comparing. Consecutive
   windows mostly share theirs; such a run of windows is a block, about one for 32 bytes of text. A block that equals an
   earlier one (fingerprints of its whole string, 128 bits) repeats it in all its windows. Blocks meet by anchor; one
   whose anchor no other place has holds no repeated window.
2. Suffixes. What is left are blocks that share an anchor but differ: the ends of shared passages. The suffixes at their
   anchors are range-partitioned by the leading bytes of the anchor with splitters that Spark samples; a bucket sorts the
   windows of an anchor by multikey quicksort, eight bytes a key, and compares neighbours.
3. Anchors that very many different blocks share (the edges of a passage that a third of all documents hold) would fill
   a bucket. Their windows are range-partitioned one by one, by all their bytes and then by place, so that even equal
   windows spread over many ranges, and each range also compares its first window with the last one before it.

Repeats are removed from the input's texts at the end, so that chains and overlaps don't matter.

Within a map task of step 1, equal blocks are reduced to the earliest at once, so copies of one text that a third of all
documents share are sent once a task. Anchors that a sample of documents shows to be very common are dealt by their
block's fingerprint; that only spreads them, the sample decides nothing else.

Odds: two different blocks with one anchor count as equal if 64 bits of hash of the anchor and 64 of the block agree: less
than n * n / 2^128 for n blocks. Steps 2 and 3 compare bytes.

Nulls: a null text is an empty one. A null id is smaller than all others. Rows that share an id are ordered by a hash
of their texts; of rows that repeat id and text altogether one counts as the first, and they meet in one task. Texts
shorter than ``width`` lose nothing. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import cleared, shuffle_partitions, stable, tidy

WIDTH = 100
PART = 32
CHUNK = 1 << 20  # bytes of text whose windows one task looks at together
SEND = 1 << 24  # bytes of text whose blocks one task reduces and sends together
BUCKET = 1 << 26  # bytes of text for each bucket of blocks
CROWD = 4096  # different blocks of one anchor that a bucket compares at most
SMALLEST = -(1 << 63)  # stands for a missing id

#: A block: hash of its anchor, fingerprint, document (row of the table sent along), first window, windows, anchor's offset.
BLOCK = np.dtype([("anchor", "u8"), ("print", "u8"), ("doc", "u4"), ("start", "u4"), ("n", "u1"), ("offset", "u1")])
NAME = np.dtype([("d", "i8"), ("th", "i8")])

_FACTOR = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _part_hashes(data: np.ndarray, part: int) -> np.ndarray:
    """A hash of the ``part`` bytes from each place on: differences of a running polynomial, brought to one power."""
    n = len(data)
    powers = np.full(n, _FACTOR, np.uint64)
    powers[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers), out=sums[1:])
    back = np.full(n - part + 1, pow(_FACTOR, -1, 1 << 64), np.uint64)
    back[0] = 1
    return _mixed((sums[part:] - sums[:-part]) * np.cumprod(back))


def _blocks(texts: list[bytes], bases: list[int], width: int, part: int, prints: bool = True) -> np.ndarray:
    """The blocks of some texts or pieces of texts (from places ``bases`` on). Hashes are compared by their upper half,
    ties go to the left."""
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    if len(data) < width:
        return np.zeros(0, BLOCK)
    hashes = _part_hashes(np.frombuffer(data, np.uint8), part)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    span, reach = width - part + 1, 1
    ranked = least
    while 2 * reach <= span:
        ranked = np.minimum(ranked[:-reach], ranked[reach:])
        reach *= 2
    windows = len(data) - width + 1
    ranked = np.minimum(ranked[:windows], ranked[span - reach : span - reach + windows])
    at = (ranked & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)[:windows]
    valid = np.flatnonzero(np.arange(windows) + width <= ends[doc])
    if not len(valid):
        return np.zeros(0, BLOCK)
    at, doc = at[valid], doc[valid]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    out = np.zeros(len(first), BLOCK)
    begin = valid[first]
    out["n"] = np.diff(np.r_[first, len(valid)])
    out["anchor"], out["doc"] = hashes[at[first]], doc[first]
    out["offset"], out["start"] = at[first] - begin, begin - (ends - sizes)[doc[first]] + np.array(bases)[doc[first]]
    if prints:
        digest = xxhash.xxh3_64_intdigest
        whole = [digest(data[a:b]) for a, b in zip(begin.tolist(), (begin + out["n"] + (width - 1)).tolist(), strict=True)]
        out["print"] = np.array(whole, np.uint64) ^ _mixed(out["offset"].astype(np.uint64))
    return out


def _chunks(batches: Iterator[pd.DataFrame], width: int) -> Iterator[tuple[np.ndarray, list[bytes], list[int]]]:
    """Names, texts and places of about CHUNK bytes at a time. A longer text comes in pieces that share no window; blocks
    cut there differ from whole ones, which step 2 sorts out."""
    names: list[tuple[int, int]] = []
    texts: list[bytes] = []
    bases: list[int] = []
    size = 0
    for b in batches:
        for d, th, text in zip(b["d"], b["th"], b["text"], strict=True):
            raw = text.encode()
            for base in range(0, max(1, len(raw) - width + 1), CHUNK):
                piece = raw[base : base + CHUNK + width - 1] if len(raw) > CHUNK else raw
                if texts and size + len(piece) > CHUNK:
                    yield np.array(names, NAME), texts, bases
                    names, texts, bases, size = [], [], [], 0
                names.append((d, th))
                texts.append(piece)
                bases.append(base)
                size += len(piece)
    if texts:
        yield np.array(names, NAME), texts, bases


def _gathered(batches: Iterator[pd.DataFrame], width: int, part: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks and names of about SEND bytes of text at a time."""
    blocks: list[np.ndarray] = []
    names: list[np.ndarray] = []
    shift = size = 0
    for who, texts, bases in _chunks(batches, width):
        own = _blocks(texts, bases, width, part)
        own["doc"] += shift
        blocks.append(own)
        names.append(who)
        shift += len(who)
        size += sum(map(len, texts))
        if size >= SEND:
            yield np.concatenate(blocks), np.concatenate(names)
            blocks, names, shift, size = [], [], 0, 0
    if blocks:
        yield np.concatenate(blocks), np.concatenate(names)


def _repeats(blocks: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by anchor, fingerprint and place, and which blocks (in it) equal an earlier one."""
    d, th = names["d"][blocks["doc"]], names["th"][blocks["doc"]]
    order = np.lexsort((blocks["start"], th, d, blocks["print"], blocks["anchor"]))
    b, d, th = blocks[order], d[order], th[order]
    fresh = np.r_[True, (b["anchor"][1:] != b["anchor"][:-1]) | (b["print"][1:] != b["print"][:-1])] if len(b) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(b)), 0))
    # the same place twice is a repeated row, not a repeat of it
    later = (d != d[head]) | (th != th[head]) | (b["start"] != b["start"][head])
    return order, later


SENT = "bucket int, blocks binary, names binary, sure boolean"


def _send(batches: Iterator[pd.DataFrame], width: int, part: int, buckets: int, common: np.ndarray) -> Iterator[pd.DataFrame]:
    """Blocks by bucket. Those that equal an earlier block of the same task's portion are sure to be repeats."""
    for blocks, names in _gathered(batches, width, part):
        order, later = _repeats(blocks, names)
        blocks = blocks[order]
        rows = []
        for sure, some in ((True, blocks[later]), (False, blocks[~later])):
            deal = np.where(np.isin(some["anchor"], common), some["print"], 0).astype(np.uint64)
            bucket = (_mixed(some["anchor"] ^ _mixed(deal)) % np.uint64(buckets)).astype(np.int64)
            place = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[place])) + 1
            for piece in np.split(place, cuts) if len(place) else []:
                own = some[piece]
                used, own["doc"] = np.unique(own["doc"], return_inverse=True)
                rows.append((int(bucket[piece[0]]), own.tobytes(), names[used].tobytes(), sure))
        yield pd.DataFrame(rows, columns=["bucket", "blocks", "names", "sure"])


#: Repeats (all n windows from start on), or blocks that share their anchor with different ones.
FOUND = "d long, th long, start int, n int, offset int, anchor long, repeat boolean"


def _found(blocks: np.ndarray, names: np.ndarray, repeat: bool) -> pd.DataFrame:
    named = names[blocks["doc"]]
    return pd.DataFrame({
        "d": named["d"], "th": named["th"], "start": blocks["start"].astype(np.int32), "n": blocks["n"].astype(np.int32),
        "offset": blocks["offset"].astype(np.int32), "anchor": blocks["anchor"].view(np.int64) if len(blocks) else np.zeros(0, np.int64), "repeat": repeat,
    })


def _meet(rows: pd.DataFrame, common: np.ndarray) -> pd.DataFrame:
    """One bucket: repeats of earlier blocks, and the blocks to look at closer."""
    out, parts, names, shift = [], [], [], 0
    for blocks, own, sure in zip(rows["blocks"], rows["names"], rows["sure"], strict=True):
        b, who = np.frombuffer(blocks, BLOCK).copy(), np.frombuffer(own, NAME)
        if sure:
            out.append(_found(b, who, True))
            continue
        b["doc"] += shift
        shift += len(who)
        parts.append(b)
        names.append(who)
    if parts:
        b, who = np.concatenate(parts), np.concatenate(names)
        order, later = _repeats(b, who)
        b = b[order]
        out.append(_found(b[later], who, True))
        kinds = b[~later]
        same = kinds["anchor"][1:] == kinds["anchor"][:-1]
        mixed = np.r_[False, same] | np.r_[same, False]
        if len(common):
            mixed |= np.isin(kinds["anchor"], common)
        out.append(_found(np.ascontiguousarray(kinds[mixed]), who, False))
    return pd.concat(out)


def _common_anchors(rows: DataFrame, size: int, width: int, part: int, share: int = 4096, sample: int = 64) -> np.ndarray:
    """Anchors of over 1 / ``share`` of all blocks by a sample of documents: about ``share`` of them at most, whatever the
    input."""

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts, bases in _chunks(batches, width):
            yield pd.DataFrame({"anchor": _blocks(texts, bases, width, part, prints=False)["anchor"].view(np.int64)})

    some = rows.filter(F.pmod(F.xxhash64("d", "th"), F.lit(sample)) == 0)
    counts = some.mapInPandas(tidy(anchors), "anchor long").groupBy("anchor").count()
    enough = max(16, 2 * size // ((width - part + 2) * sample * share))
    return np.array(sorted(r["anchor"] for r in counts.filter(F.col("count") > enough).collect()), np.int64).view(np.uint64)


def multikey_order(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes by multikey quicksort with keys of eight bytes: each pass cuts the segments that still tie by
    their next key, and leaves those of one row. Returns the order and where a new string begins in it."""
    m, width = strings.shape
    padded = np.zeros((m, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = strings
    keys = padded.view(">u8").astype(np.uint64)
    order = np.arange(m)
    begins = np.zeros(m, bool)
    begins[:1] = True
    open_ = np.arange(m)  # places in segments of two rows or more
    for k in range(keys.shape[1]):
        if len(open_) < 2:
            break
        rows = order[open_]
        segment = np.cumsum(begins[open_])
        by = np.lexsort((keys[rows, k], segment))
        rows = order[open_] = rows[by]
        key = keys[rows, k]
        begins[open_[1:]] |= key[1:] != key[:-1]
        ends = np.r_[begins[1:], True][:m]
        open_ = open_[~(begins[open_] & ends[open_])]
    return order, begins


def _later_windows(strings: np.ndarray, d: np.ndarray, th: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which windows equal one that starts earlier. Also the order by string and where strings begin in it."""
    order, begins = multikey_order(strings)
    segment = np.cumsum(begins)
    order = order[np.lexsort((at[order], th[order], d[order], segment))]
    head = order[np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0))]
    late = (d[order] != d[head]) | (th[order] != th[head]) | (at[order] != at[head])
    out = np.zeros(len(order), bool)
    out[order] = late
    return out, order, begins


BLOCKS = "d long, th long, start int, n int, offset int, anchor long, string binary, lead binary"


def _cut_out(batches: Iterator[pd.DataFrame], width: int, part: int) -> Iterator[pd.DataFrame]:
    """The strings of blocks from texts with their lists of blocks."""
    for b in batches:
        rows = []
        for d, th, text, wanted in zip(b["d"], b["th"], b["text"], b["wanted"], strict=True):
            raw = text.encode()
            for w in wanted:
                a, o = w["start"], w["offset"]
                rows.append((d, th, a, w["n"], o, w["anchor"], raw[a : a + w["n"] + width - 1], raw[a + o : a + o + part]))
        yield pd.DataFrame(rows, columns=["d", "th", "start", "n", "offset", "anchor", "string", "lead"])


RUNS = "d long, th long, start int, n int"


def _windows(b: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some blocks: their bytes, and d, th and start of each."""
    n = b["n"].to_numpy()
    sizes = n + width - 1
    data = np.frombuffer(b"".join(b["string"]), np.uint8)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    strings = np.lib.stride_tricks.sliding_window_view(data, width)[np.repeat(np.cumsum(sizes) - sizes, n) + inside]
    return strings, np.repeat(b["d"].to_numpy(), n), np.repeat(b["th"].to_numpy(), n), np.repeat(b["start"].to_numpy(), n) + inside


def _runs(d: np.ndarray, th: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Neighbouring windows of a document as one run."""
    order = np.lexsort((at, th, d))
    d, th, at = d[order], th[order], at[order]
    first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (th[1:] != th[:-1]) | (at[1:] > at[:-1] + 1)]) if len(at) else np.zeros(0, int)
    last = np.r_[first[1:], len(at)][: len(first)] - 1
    return pd.DataFrame({"d": d[first], "th": th[first], "start": at[first].astype(np.int32), "n": (at[last] - at[first] + 1).astype(np.int32)})


def _compare_leads(batches: Iterator[pd.DataFrame], width: int, most: int = 50_000) -> Iterator[pd.DataFrame]:
    """A bucket of blocks, sorted by the leading bytes of their anchors; whole anchors are compared at a time."""
    rest: list[pd.DataFrame] = []
    size = 0

    def look() -> pd.DataFrame:
        strings, d, th, at = _windows(pd.concat(rest), width)
        late = _later_windows(strings, d, th, at)[0]
        return _runs(d[late], th[late], at[late])

    for b in batches:
        lead = b["lead"].to_numpy()
        cuts = [0, *(np.flatnonzero(lead[1:] != lead[:-1]) + 1).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if size > most and rest[-1]["lead"].iloc[-1] != lead[x]:
                yield look()
                rest, size = [], 0
            rest.append(b.iloc[x:y])
            size += int(b["n"].iloc[x:y].sum())
    if rest:
        yield look()


def _explode(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), 1000):
            if len(piece := b.iloc[k : k + 1000]):
                strings, d, th, at = _windows(piece, width)
                yield pd.DataFrame({"d": d, "th": th, "at": at.astype(np.int32), "string": [s.tobytes() for s in strings]})


def _compare_ranges(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Ranges of windows, each in order of bytes and places, with ``before``: the last string of the ranges before."""
    part = last = None
    for batch in batches:
        cuts = [0, *(np.flatnonzero(np.diff(batch["part"].to_numpy())) + 1).tolist(), len(batch)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            if x == y:
                continue
            b = batch.iloc[x:y]
            if b["part"].iloc[0] != part:
                part, last = b["part"].iloc[0], b["before"].iloc[0]
            strings = np.frombuffer(b"".join(b["string"]), np.uint8).reshape(len(b), width)
            d, th, at = b["d"].to_numpy(), b["th"].to_numpy(), b["at"].to_numpy()
            late, order, begins = _later_windows(strings, d, th, at)
            if b["string"].iloc[0] == last:  # the first string has begun before
                late[order[np.cumsum(begins) == 1]] = True
            last = b["string"].iloc[-1]
            yield _runs(d[late], th[late], at[late])


def _crowded(windows: DataFrame, width: int) -> DataFrame:
    """Step 3: runs of repeated windows of crowded anchors."""
    spark = windows.sparkSession
    by = ["string", "d", "th", "at"]
    ranges = windows.repartitionByRange(shuffle_partitions(spark), *by)
    ranged = stable(ranges.withColumn("part", F.spark_partition_id()))
    ends = ranged.groupBy("part").agg(F.max("string").alias("last"))  # one row a range
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("part", F.max("last").over(line).alias("before"))
    joined = ranged.join(before, "part").repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", *by)
    return joined.select("part", *by, "before").mapInPandas(tidy(lambda x: _compare_ranges(x, width)), RUNS)


def repeated_runs(rows: DataFrame, width: int = WIDTH, part: int = PART, crowd: int = CROWD) -> DataFrame:
    """(d, th, start, n): runs of windows that also start earlier, of rows (d, th, text). Writes tables to the shared folder."""
    spark = rows.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET))
    common = _common_anchors(rows, size, width, part)
    sent = rows.mapInPandas(tidy(lambda x: _send(x, width, part, buckets, common)), SENT)
    found = stable(sent.repartition(shuffle_partitions(spark), "bucket").groupBy("bucket").applyInPandas(lambda b: _meet(b, common), FOUND))
    mixed = found.filter("not repeat")
    wanted = mixed.groupBy("d", "th").agg(F.collect_set(F.struct("start", "n", "offset", "anchor")).alias("wanted"))
    texts = rows.join(wanted, ["d", "th"]).dropDuplicates(["d", "th"]).select("d", "th", "text", "wanted")
    blocks = stable(texts.mapInPandas(tidy(lambda x: _cut_out(x, width, part)), BLOCKS))
    crowded = stable(blocks.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"))
    columns = ["d", "th", "start", "n", "string", "lead"]
    some = not crowded.isEmpty()  # as a rule there is none
    usual = blocks.join(crowded, "anchor", "left_anti") if some else blocks
    leads = usual.select(columns).repartitionByRange(shuffle_partitions(spark), "lead").sortWithinPartitions("lead")
    runs = found.filter("repeat").select("d", "th", "start", "n").unionByName(leads.mapInPandas(tidy(lambda x: _compare_leads(x, width)), RUNS))
    if some:
        windows = blocks.join(crowded, "anchor", "left_semi").select(columns).mapInPandas(tidy(lambda x: _explode(x, width)), "d long, th long, at int, string binary")
        runs = runs.unionByName(_crowded(windows, width))
    return runs


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<struct<start:int,end:int>>"


def _remove(batches: Iterator[pd.DataFrame], width: int, texts: bool) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for i, text, copy, runs in zip(b["doc_id"], b["text"], b["copy"], b["runs"], strict=True):
            raw = text.encode()
            if copy > 1 and len(raw) >= width:
                spans = [(0, len(raw))]
            elif runs is None or not len(runs):
                spans = []
            else:
                a, n = np.array([(r["start"], r["n"]) for r in runs]).T
                order = np.argsort(a, kind="stable")
                a, e = a[order], np.maximum.accumulate((a + n + width - 1)[order])
                first = np.flatnonzero(np.r_[True, a[1:] > e[:-1]])
                spans = list(zip(a[first].tolist(), e[np.r_[first[1:], len(a)] - 1].tolist(), strict=True))
            kept = b"".join(raw[x:y] for x, y in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)], strict=True))
            gone = len(raw) - len(kept)
            rows.append((None if pd.isna(i) else int(i), len(raw), gone, len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="replace") if texts else None, [{"start": x, "end": y} for x, y in spans]))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])
        yield out.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, width: int = WIDTH, part: int = PART, crowd: int = CROWD, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: sizes, spans removed (bytes, end exclusive), a digest of what is kept and, with ``texts``, the
    kept text itself (bytes of a cut character become a replacement character)."""
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"d": F.coalesce("doc_id", F.lit(SMALLEST)), "th": F.xxhash64("text")}
    )
    out = None
    with cleared(docs.sparkSession, lambda: out):
        long_enough = rows.filter(F.octet_length("text") >= width).select("d", "th", "text")
        runs = repeated_runs(long_enough, width, part, crowd).groupBy("d", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
        copy = F.row_number().over(Window.partitionBy("d", "th").orderBy("d"))
        named = rows.join(runs, ["d", "th"], "left").withColumn("copy", copy).select("doc_id", "text", "copy", "runs")
        out = stable(named.mapInPandas(tidy(lambda x: _remove(x, width, texts)), KEPT))
    return out


def op12_suffix_dedup(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Windows are cut out of pieces of 512 bytes, as a place far into a long string is slow to reach.
OP12_SQL = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, k * 512 as base, substr(h, k * 1024 + 1, 1024 + 198) as piece from t, unnest(range(0, greatest(length(h) // 2 - 99, 0) // 512 + 1)) u(k)),
w as (select doc_id, base + j as p, substr(piece, 2 * j + 1, 200) as s from pieces, unnest(range(0, least(512, length(piece) // 2 - 99))) u(j)),
late as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as r from w) where r > 1),
islands as (select doc_id, p, sum(new) over (partition by doc_id order by p) as island from (
  select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as new from late)),
spans as (select doc_id, island, min(p) as a, max(p) + 100 as b from islands group by 1, 2),
per as (select doc_id, list(a order by a) as l, list(b order by a) as r from spans group by 1)
select doc_id, (length(h) // 2)::bigint as n_bytes,
  coalesce(list_sum(r) - list_sum(l), 0)::bigint as n_removed, coalesce(len(l), 0)::bigint as n_spans,
  sha256(unhex(case when l is null then h else array_to_string(list_transform(range(0, len(l) + 1),
    lambda i: substr(h, (case when i = 0 then 0 else r[i] end) * 2 + 1, ((case when i = len(l) then length(h) // 2 else l[i + 1] end) - (case when i = 0 then 0 else r[i] end)) * 2)), '') end)) as kept_sha256
from t left join per using (doc_id)
"""
