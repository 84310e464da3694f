"""What each of five filters removes, in every order they may be applied in.

A document's failures are five bits. Four of them are functions of its text. The fifth, "identical to the text of a
smaller doc_id", comes from a sort: rows are range-partitioned by fingerprint and id (Spark samples the splitters), sorted
by fingerprint, full text and id, and each row is compared with the one before it; texts are compared in full wherever
fingerprints are equal. A group of copies may stretch over several ranges, however large it is. So each range also reports
the first row of every text in its first and its last fingerprint (as a rule two rows), and a second pass, over these
rows alone, marks those whose text an earlier range has reported already.

Order effects need no second look at documents: counts by part and failure mask are additive, and what a filter at a place
of an order removes is a sum over masks. So there are at most 32 counters a part, whatever the input.

Nulls: a null text is the empty text, a null lang and an empty lang are the part ``""``. A row without id is neither
smaller nor larger than others: it never fails E, nor does any row because of it. Rows that repeat an id are documents of
their own; a copy with the same id isn't one of a smaller id. A document is of good quality or toxic if any of its labels
says so. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import shuffle_partitions, stable, tidy

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    bits = (
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(bad, 1 << k).otherwise(0) for k, bad in enumerate(bits)), F.lit(0))


MARKED = "id long, lang string, mask int, part int, h long, edge string"


def _mark(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, sorted by fingerprint h, text and id: adds the copy bit as far as this range can tell. ``edge`` is the
    text of rows that are the first of their text here, in the first or last fingerprint of the range."""
    part = None
    first_h = last_h = text = first_id = None
    held: list[tuple] = []  # first rows of texts in the fingerprint at hand; they may be the range's last ones
    for batch in rows:
        out: list[tuple] = []
        cols = [batch.column(k).to_pylist() for k in range(5)]
        texts = batch.column(5)
        for k, (i, lang, mask, h, part) in enumerate(zip(*cols, strict=True)):
            if h != last_h:
                out += held if first_h == last_h else [(*r[:5], None) for r in held]
                held, last_h, text, first_id = [], h, None, None
                first_h = h if first_h is None else first_h
            own = texts[k].as_py()
            if own != text:
                text, first_id = own, None
            if i is None:
                out.append((i, lang, mask, part, h, None))
            elif first_id is None or i == first_id:
                first_id = i
                held.append((i, lang, mask, part, h, own))
            else:
                out.append((i, lang, mask | COPY, part, h, None))
        if out:
            yield _batch(out)
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "lang", "mask", "part", "h", "edge"])


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, lang, mask) of every row: five bits for the filters A to E. Writes a table without texts (but for a few rows a
    range) to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("lang"),
        failures(text).alias("mask"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
    )
    ranges = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "h", "id")
    ordered = ranges.sortWithinPartitions("h", "text", "id").select("id", "lang", "mask", "h", F.spark_partition_id().alias("part"), "text")
    marked = stable(ordered.mapInArrow(tidy(_mark), MARKED))
    seen = F.min("part").over(Window.partitionBy("h", "edge"))  # the first rows of a text: a few for each range that holds it
    edges = marked.filter("edge is not null").withColumn("mask", F.when(seen < F.col("part"), F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")))
    return edges.unionByName(marked.filter("edge is null")).select("id", "lang", "mask")


def audit(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All orders and steps of every part, from (id, lang, mask) and labels (id, quality, toxic)."""
    flags = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    counters = masks.join(flags, "id", "left").groupBy("lang", "mask").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(("".join(order), k + 1, before, bit))
            before |= bit
    every = F.expr("inline(array(" + ",".join(f"named_struct('filter_order','{o}','step',{s},'before',{b},'bit',{x})" for o, s, b, x in steps) + "))")
    rows = counters.select("lang", "mask", "n", "good", "toxic", every)
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda cond, of: F.coalesce(F.sum(F.when(cond, of)), F.lit(0))
    # of all orders, a filter comes first of the k that a document fails in one of k
    share = F.expr("n * 120 div greatest(bit_count(mask), 1)")
    return rows.groupBy(F.col("lang").alias("part"), "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"),
        total(fails & ~earlier, F.col("n")).alias("removed"),
        total(fails & earlier, F.col("n")).alias("redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(fails & ~earlier, F.col("good")).alias("good_lost"),
        total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def op13_filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_masks(docs), labels)


OP13_SQL = r"""
with recursive w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), m as (
  select doc_id, part, (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
    + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(doc_id > first_id, false)::int as mask
  from w
), l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
c as (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(l.toxic), 0) as toxic from m left join l using (doc_id) group by 1, 2),
p(o) as (select '' union all select o || f from p, (select unnest(['A', 'B', 'C', 'D', 'E']) as f) where not contains(o, f)),
s as (
  select o as filter_order, step, (1 << (ascii(o[step]) - 65))::int as bit,
    coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(o[j]) - 65))), 0)::int as before
  from p, (select unnest([1, 2, 3, 4, 5]) as step) where len(o) = 5
)
select part, filter_order, step,
  coalesce(sum(n) filter (mask & (before | bit) = 0), 0)::bigint as kept,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0)::bigint as redundant,
  coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as good_lost,
  coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & bit <> 0), 0)::bigint as shapley
from c, s group by 1, 2, 3
"""
