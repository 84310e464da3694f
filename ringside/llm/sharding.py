"""Balanced contiguous shards from global byte-size prefix sums.

Every document gets a place on one line of bytes: the order is a hash of the text, then a salt of the id, then the
id. Prefix sums come in three steps, so that no task ever holds more than a small part of the line: totals of hash
buckets (a few thousand rows), running sums of cells within a bucket, running sums of rows within a cell. A cell is
one text and one salt, so a text that a third of all documents share is spread over ``salts`` cells. The line is cut
at equal byte targets. Texts are read once: their sizes and hashes are written (some 40 bytes a document), all sums read
that table, and places are written before shards are numbered from 0.

Equal texts are neighbours on the line. A group of equal texts that is small against a shard (a share of it, the same at
every size) stays in one shard, the one where its middle lies; a larger group is cut like any other bytes, since sizes
have to be near equal.

Nulls: a null text has no bytes and counts as equal to the empty text; a null id sorts first. Repeated rows each get
their own slot. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import drop, stable

BUCKET_BITS = 12


def _hash(x: Column, digits: int) -> Column:
    """The first hexadecimal digits of the MD5 sum, as a number."""
    return F.conv(F.substring(F.md5(x), 1, digits), 16, 10).cast("long")


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
    overhead: int = 8,
    salts: int = 256,
    whole_parts: int = 50,
) -> DataFrame:
    """Assign ``shard`` and a gapless ``slot`` to every row of ``docs``.

    A group of equal texts of at most ``1 / whole_parts`` of a shard's bytes is never split. ``overhead`` is added to
    the bytes of each text. Returns id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text).alias("text_crc32"),
        _hash(text, 15).alias("h"),
    ).select(
        "*",
        F.shiftrightunsigned("h", 60 - BUCKET_BITS).alias("hb"),
        (_hash(F.coalesce(F.col("id").cast("string"), F.lit("")), 8) % salts).cast("int").alias("sub"),
    )
    rows = stable(told)
    cells = rows.groupBy("hb", "h", "sub").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))

    # at most 2 ** BUCKET_BITS rows, whatever the input
    line = Window.orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cells.groupBy("hb")
        .agg(F.sum("bytes").alias("b"), F.sum("n").alias("c"))
        .select(
            "hb",
            F.coalesce(F.sum("b").over(line), F.lit(0)).alias("bucket_byte"),
            F.coalesce(F.sum("c").over(line), F.lit(0)).alias("bucket_row"),
            F.sum("b").over(Window.partitionBy()).alias("total"),
        )
    )
    before = Window.partitionBy("hb").orderBy("h", "sub").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("hb", "h")
    placed_cells = (
        cells.select(
            "hb", "h", "sub",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("cell_byte"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_row"),
            F.sum("bytes").over(group).alias("group_bytes"),
        )
        .withColumn("group_byte", F.min("cell_byte").over(group))
        .join(F.broadcast(offsets), "hb")
        .select(
            "hb", "h", "sub", "total", "group_bytes",
            (F.col("group_byte") + F.col("bucket_byte")).alias("group_byte"),
            (F.col("cell_byte") + F.col("bucket_byte")).alias("cell_byte"),
            (F.col("cell_row") + F.col("bucket_row")).alias("cell_row"),
        )
    )
    within = Window.partitionBy("hb", "h", "sub").orderBy("id")
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("group_bytes") * (n_shards * whole_parts) <= F.col("total")
    middle2 = F.when(whole, 2 * F.col("group_byte") + F.col("group_bytes")).otherwise(
        2 * (F.col("cell_byte") + F.coalesce(F.sum("size").over(earlier), F.lit(0))) + F.col("size")
    )
    placed = (
        rows.join(placed_cells, ["hb", "h", "sub"])
        .withColumn("middle2", middle2)
        .withColumn("row", F.col("cell_row") + F.row_number().over(within) - 1)
        .select(
            "id", "size", "text_crc32", "row",
            F.least(F.expr(f"(middle2 * {n_shards}) div (2 * total)"), F.lit(n_shards - 1)).cast("int").alias("shard"),
        )
    )
    placed = stable(placed)
    drop(rows)
    starts = placed.groupBy("shard").agg(F.min("row").alias("start"))  # one row a shard
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("row") - F.col("start")).alias("slot")
    )


def op10_sharding(docs: DataFrame) -> DataFrame:
    return shard_documents(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The CRC is reckoned byte by byte with the table of its polynomial.
OP10_SQL = """
with recursive steps(k, b, v) as (
  select 0, b, b::bigint from range(256) t(b)
  union all select k + 1, b, case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end from steps where k < 8
), crc as (select list(v order by b) as t from steps where k = 8), texts as (select distinct coalesce(text, '') as text from documents), sums as (
  select text, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint)::bigint as text_crc32
  from texts, crc
), r as (
  select doc_id, (octet_length(encode(coalesce(d.text, ''))) + 8)::bigint as size, text_crc32, ('0x' || substr(md5(coalesce(d.text, '')), 1, 15))::bigint as h,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % 256 as sub
  from documents d join sums s on s.text = coalesce(d.text, '')
), line as (
  select *, row_number() over w - 1 as row, sum(size) over w - size as start, sum(size) over () as total, sum(size) over (partition by h) as group_bytes
  from r window w as (order by h, sub, doc_id nulls first rows between unbounded preceding and current row)
), middle as (
  select *, case when group_bytes * 24 * 50 <= total then 2 * min(start) over (partition by h) + group_bytes else 2 * start + size end as middle2 from line
), placed as (select *, least((middle2 * 24) // (2 * total), 23)::int as shard from middle)
select doc_id, size, text_crc32, 'bytes' as law, shard, (row - min(row) over (partition by shard))::bigint as slot, null::int as grown_shard from placed
"""
