"""A Merkle manifest of a table: one root over all rows, and for each row a proof against it.

A row is a leaf; the leaves of a group (a lang) make a tree of eight children a node in order of id, and the roots of
these trees, in order of the groups, make the top tree. Places in the order come from a range sort, counts of each range
and prefix sums of those, so no task numbers a whole group.

Digests then travel in Pregel-style supersteps over RDDs. Upward, children message their parents; a parent that has heard
of all its children hashes them and messages its own parent, the others wait (roots of small groups wait for those of
large ones). Downward, nodes tell their children the runs of siblings on the way to the root, level by level. The last
step stays at the parents of the leaves, where it meets each leaf once, so that paths aren't copied for every leaf. A node
has at most eight children and a path one entry a level, so nothing in a task grows with a group. Every superstep is a
table in the shared folder: a lost executor repeats one step.

Verification folds a leaf, recomputed from what is stored now, with the siblings of its proof.

Nulls: a null group is a group and comes first, null ids come first in their group and are never tampered with (they
have no decimal form). Rows that share group and id are ordered by their leaf; rows that repeat altogether are leaves of
their own. A null field is a ``-``, an empty one ``0:``. A lone leaf is its tree's root, a lone tree the root of all; its
proof is the hash of nothing. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ringside.llm.common import cleared, drop, shuffle_partitions, stable

FAN = 8
TOP = -1  # the tree over the roots of groups
ROOT = -1  # level that names the root of a group's tree, whatever its height

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, idx long, m long, kids binary, digest binary"
PATHS = "tree long, level int, idx long, subroot binary, path binary"
PROVEN = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"

Key = tuple[int, int, int]


def _field(x: Column) -> Column:
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def _leaf(docs: DataFrame, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(id, grp, leaf, bad): bad is the leaf of the row as it is found later, where that differs. ``grp`` sorts like lang,
    null first."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    found = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", upper, lower))
    bad = F.when(found != F.col("text"), _leaf(docs, found))
    grp = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(F.col("doc_id").cast("long").alias("id"), grp.alias("grp"), _leaf(docs, F.col("text")).alias("leaf"), bad.alias("bad"))


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """Leaves with their tree (place of the group among groups), pos (place in the group) and m (leaves of the group);
    and the number of trees."""
    spark = rows.sparkSession
    order = ["grp", "id", "leaf"]
    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stable(ranges.select("*", F.spark_partition_id().alias("part"), inside.alias("row")))
    runs = ranged.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("row").alias("start"))
    earlier = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("grp", "part", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("grp")).alias("m"))
    # groups are numbered range by range too: a group counts where it begins
    begins = runs.filter("before = 0").select("grp", "part")
    offsets = begins.groupBy("part").agg(F.count("*").alias("k"))  # one row a range
    line = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("part", F.coalesce(F.sum("k").over(line), F.lit(0)).alias("offset"))
    trees = begins.join(offsets, "part").select("grp", (F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1).alias("tree"))
    out = ranged.join(runs.join(trees, "grp"), ["grp", "part"]).select("id", "leaf", "bad", "tree", "m", (F.col("before") + F.col("row") - F.col("start")).alias("pos"))
    return out, begins.count()


def _parent(tree: int, level: int, idx: int, size: int, trees: int) -> Key | None:
    """Whom a node messages; ``size`` is the number of nodes of its level."""
    if size > 1:
        return tree, level + 1, idx // FAN
    return (TOP, 1, tree // FAN) if tree != TOP and trees > 1 else None


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _runs(kids: bytes) -> list[tuple[int, bytes]]:
    return sorted((kids[k], kids[k + 1 : k + 33]) for k in range(0, len(kids), 33))


def _upward(r: Row, trees: int) -> Iterator[tuple[Key, tuple[int, bytes]]]:
    """A finished node's message to its parent, or what a waiting node has heard so far."""
    if r.digest is None:
        yield (r.tree, r.level, r.idx), (r.m, bytes(r.kids))
        return
    size = -(-r.m // FAN) if r.level else r.m
    to = _parent(r.tree, r.level, r.idx, size, trees)
    if to:
        slot = (r.idx if to[0] == r.tree else r.tree) % FAN
        yield to, (size if to[0] == r.tree else trees, bytes([slot]) + bytes(r.digest))


def _finish(x: tuple[Key, tuple[int, bytes]]) -> tuple:
    (tree, level, idx), (m, kids) = x
    done = len(kids) == 33 * min(FAN, m - FAN * idx)
    return tree, level, idx, m, kids, _hash([d for _, d in _runs(kids)]) if done else None


def climb(rows: DataFrame, trees: int) -> list[DataFrame]:
    """Upward supersteps from leaves (tree, level 0, idx, m, kids, digest); a table of nodes for each step. A node of a
    group's tree is finished in the step of its level."""
    spark, steps, parts = rows.sparkSession, [], shuffle_partitions(rows.sparkSession)
    active = rows
    while True:
        parts = max(1, parts // FAN if steps else parts)
        heard = active.rdd.flatMap(lambda r: _upward(r, trees)).reduceByKey(lambda a, b: (a[0], a[1] + b[1]), parts)
        nodes = stable(spark.createDataFrame(heard.map(_finish), NODES))
        if nodes.isEmpty():
            drop(nodes)
            return steps
        steps.append(nodes)
        active = nodes


def _keyed(r: Row) -> Iterator[tuple[Key, tuple[int, bytes]]]:
    """A node by its own key and, if it is the root of a group's tree, also by that name."""
    yield (r.tree, r.level, r.idx), (r.level, bytes(r.kids))
    if r.tree != TOP and r.m <= FAN:
        yield (r.tree, ROOT, 0), (r.level, bytes(r.kids))


def _entry(kids: list[tuple[int, bytes]], slot: int) -> bytes:
    return bytes([len(kids), slot]) + b"".join(d for _, d in kids)


def _downward(x: tuple[Key, tuple], leaves_next: bool) -> Iterator[tuple]:
    """What a node tells its children; the parents of leaves keep it for them."""
    (tree, _, idx), (told, own) = x
    for (subroot, path), level, kids in ((t, at, _runs(k)) for t in told for at, k in own):
        if leaves_next:
            yield tree, level, idx, subroot, _entry(kids, 0) + path
            continue
        for slot, digest in kids:
            below = _entry(kids, slot) + path
            if tree == TOP and level == 1:
                yield FAN * idx + slot, ROOT, 0, digest, below
            else:
                yield tree, level - 1, FAN * idx + slot, subroot, below


def _told(t: DataFrame) -> RDD:
    return t.rdd.map(lambda r: ((r.tree, r.level, r.idx), (bytes(r.subroot), bytes(r.path))))


def descend(steps: list[DataFrame], root: Row, trees: int) -> DataFrame:
    """Downward supersteps: (tree, level, idx, subroot, path) for the parents of leaves (level 1), with the run of leaves
    as the first entry of the path (slot 0, each leaf puts its own), and for lone leaves (level ROOT)."""
    spark, parts = steps[0].sparkSession, shuffle_partitions(steps[0].sparkSession)
    say = lambda rows: spark.createDataFrame(rows, PATHS)
    top = steps[0].filter("false")
    for s in steps:
        top = top.unionByName(s.filter((F.col("tree") == TOP) & F.col("digest").isNotNull()))
    if root.tree == TOP:
        told, subroots, high = say([(root.tree, root.level, root.idx, b"", b"")]), None, root.level
    else:
        told, subroots, high = None, say([(root.tree, ROOT, 0, bytes(root.digest), b"")]), 0
    for level in range(high, 0, -1):
        own = top.filter(F.col("level") == level).rdd.flatMap(_keyed)
        told = stable(say(_told(told).cogroup(own, parts).flatMap(lambda x: _downward(x, False))))
    subroots = subroots if subroots is not None else told
    told = None
    for level in range(len(steps), 0, -1):
        here = steps[level - 1].filter((F.col("tree") != TOP) & (F.col("level") == level))
        if here.isEmpty():
            continue
        heard = subroots if told is None else subroots.unionByName(told)
        spread = max(1, parts // FAN ** (level - 1))
        told = stable(say(_told(heard).cogroup(here.rdd.flatMap(_keyed), spread).flatMap(lambda x, last=level == 1: _downward(x, last))))
    return subroots if told is None else told.unionByName(subroots)


def _prove(x: tuple[Key, tuple]) -> Iterator[tuple]:
    """The proofs of the leaves of one parent."""
    for subroot, path in x[1][0]:
        entries, at = [], 0
        while at < len(path):
            n, slot = path[at], path[at + 1]
            entries.append((slot, [path[k : k + 32].hex() for k in range(at + 2, at + 2 + 32 * n, 32)]))
            at += 2 + 32 * n
        for i, leaf, bad, pos in x[1][1]:
            proof, now = hashlib.sha256(), (bad or leaf).hex()
            for k, (slot, run) in enumerate(entries):
                own = pos % FAN if k == 0 and x[0][1] == 1 else slot
                left, right = "".join(run[:own]), "".join(run[own + 1 :])
                proof.update((left + right).encode())
                now = hashlib.sha256((left + now + right).encode()).hexdigest()
            yield i, leaf.hex(), subroot.hex(), proof.hexdigest(), now


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    spark = docs.sparkSession
    out = None
    with cleared(spark, lambda: out):
        rows, trees = placed(leaves(docs))
        rows = stable(rows)
        none = F.lit(None).cast("binary")
        start = rows.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), "m", none.alias("kids"), F.col("leaf").alias("digest"))
        steps = climb(start, trees)
        if steps:
            root = steps[-1].first()  # the last step finishes one node
            paths = descend(steps, root, trees)
            top = bytes(root.digest).hex()
        else:  # no leaf or a single one
            one = rows.first()
            top = bytes(one.leaf).hex() if one else ""
            paths = spark.createDataFrame([(one.tree, ROOT, 0, bytes(one.leaf), b"")] if one else [], PATHS)
        own = rows.rdd.map(lambda r: ((r.tree, 1, r.pos // FAN) if r.m > 1 else (r.tree, ROOT, 0), (r.id, bytes(r.leaf), bytes(r.bad) if r.bad is not None else None, r.pos)))
        proven = spark.createDataFrame(_told(paths).cogroup(own, shuffle_partitions(spark)).flatMap(_prove), PROVEN)
        out = stable(proven.select("doc_id", "leaf", "subroot", F.lit(top).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified")))
    return out


def op11_merkle(docs: DataFrame) -> DataFrame:
    return manifest(docs)


#: Levels are lists of digests; a leaf's way up is a chain of (level, digest, proof so far).
OP11_SQL = """
with recursive crc_steps(k, b, v) as (
  select 0, b, b::bigint from range(256) t(b)
  union all select k + 1, b, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end from crc_steps where k < 8
), crc as (select list(v order by b) as t from crc_steps where k = 8), d as (
  select doc_id, lang, text, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 3 = 0 as tampered
  from documents, crc
), h as (
  select doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when tampered then sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as bad
  from d
), leaves as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos from h),
groups as (select lang, list(leaf order by pos) as l from leaves group by lang),
tree(lang, level, l) as (
  select lang, 0, l from groups
  union all select lang, level + 1, list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], ''))) from tree where len(l) > 1
), subroots as (select lang, l[1] as subroot, row_number() over (order by lang nulls first) - 1 as g from tree where len(l) = 1),
top(level, l) as (
  select 0, list(subroot order by g) from subroots
  union all select level + 1, list_transform(range(0, len(l), 8), lambda i: sha256(array_to_string(l[i + 1:i + 8], ''))) from top where len(l) > 1
), low(doc_id, lang, leaf, pos, level, proof, cur) as (
  select doc_id, lang, leaf, pos, 0, '', coalesce(bad, leaf) from leaves
  union all
  select w.doc_id, w.lang, leaf, pos // 8, w.level + 1, proof || a || b, sha256(a || cur || b) from (
    select w.*, array_to_string(l[pos // 8 * 8 + 1:pos], '') as a, array_to_string(l[pos + 2:pos // 8 * 8 + 8], '') as b
    from low w join tree t on w.lang is not distinct from t.lang and w.level = t.level where len(l) > 1
  ) w
), high(doc_id, lang, leaf, subroot, pos, level, proof, cur) as (
  select doc_id, w.lang, leaf, subroot, g, 0, proof, cur from low w join tree t on w.lang is not distinct from t.lang and w.level = t.level and len(l) = 1
    join subroots s on w.lang is not distinct from s.lang
  union all
  select doc_id, lang, leaf, subroot, pos // 8, level + 1, proof || a || b, sha256(a || cur || b) from (
    select w.*, array_to_string(l[pos // 8 * 8 + 1:pos], '') as a, array_to_string(l[pos + 2:pos // 8 * 8 + 8], '') as b
    from high w join top t on w.level = t.level where len(l) > 1
  )
)
select doc_id, leaf, subroot, l[1] as root, sha256(proof) as proof_sha256, cur as folded_root, cur = l[1] as verified
from high w join top t on w.level = t.level and len(l) = 1
"""
