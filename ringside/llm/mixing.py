"""Mix sources to target weights with Sainte-Lague apportionment.

The words of all documents are the budget. Each source gets a target: its weight's share of the budget, at most
``max_epochs`` times its own words, what is over being shared again by weight. The budget is a number of equal blocks
of words. Blocks go to sources, and then a source's blocks to its shards, one by one to the highest quotient
``weight / (2 k - 1)``: integer quotas that add up exactly. Within a shard the documents form one stream in seeded
order; the quota is a run of blocks on that stream from a seeded block onwards, round and round.

Highest quotients need no loop: every member surely gets the seats below its share by half the members' sum of
rounding errors, so that only the few seats around its exact share are ranked against each other.

Nulls: a null source is a source of its own, after all others; a null or blank text has 0 words and is taken 0 times.
Repeated rows are documents of their own. An empty table gives an empty result. The tables of sources and shards
hold one row for each source, or source and shard; rows of documents are only joined to them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def apportion(members: DataFrame, by: list[str], weight: str, seats: str, order: list[str], out: str) -> DataFrame:
    """Give ``seats`` (the same in all rows of a group ``by``) to the rows of the group by Sainte-Lague.

    Ties go to the first in ``order``. Rows of no weight get no seats.
    """
    group = Window.partitionBy(*by)
    share = F.try_divide(F.col(weight).cast("double"), F.sum(F.col(weight).cast("double")).over(group))
    slack = share * F.count("*").over(group) / 2 + 0.5
    bounds = (
        members.withColumn("_share", F.coalesce(share, F.lit(0.0)))
        .withColumn("_slack", F.coalesce(slack, F.lit(0.5)))
        .withColumn("_sure", F.greatest(F.floor(F.col("_share") * F.col(seats) - F.col("_slack")), F.lit(0)))
        .withColumn("_most", F.ceil(F.col("_share") * F.col(seats) + F.col("_slack")))
        .withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    )
    first = Window.partitionBy(*by).orderBy(F.col("_quotient").desc(), *order, "_seat")
    won = (
        bounds.filter(F.col("_share") > 0)
        .select("*", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_seat"))
        .withColumn("_quotient", F.col(weight).cast("double") / (2 * F.col("_seat") - 1))
        .withColumn("_won", (F.row_number().over(first) <= F.col("_left")).cast("long"))
        .groupBy(*members.columns, "_sure")
        .agg((F.first("_sure") + F.sum("_won")).alias(out))
        .drop("_sure")
    )
    none = bounds.filter(F.col("_share") <= 0).select(*members.columns, F.lit(0).cast("long").alias(out))
    return won.unionByName(none)


def source_targets(sources: DataFrame, weights: list[int], max_epochs: int) -> DataFrame:
    """Add ``target`` to one row a source (key, source_size): water-filling under caps, in closed form.

    In order of cap to weight, the capped sources are a prefix: the source after it is the first whose cap is not
    below its share of what the prefix leaves.
    """
    everything = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy("key")) - 1
    weight: Column = reduce(lambda c, kv: F.when(F.col("_rank") % len(weights) == kv[0], kv[1]).otherwise(c), enumerate(weights), F.lit(0))
    fill = Window.orderBy("_ratio", "key")
    return (
        sources.withColumn("_rank", rank)
        .withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", F.col("source_size") * float(max_epochs))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_spent", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("total") - F.col("_spent")) / F.col("_open"))
        .withColumn("_first", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "key", "_level"))).over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_first._level") * F.col("_weight"), F.col("_cap"))))
        .select("key", "source_size", "total", "target")
    )


def source_key(source: Column) -> Column:
    """Sorts like the source, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 17,
    shards: int = 256,
    blocks: int = 1 << 20,
) -> DataFrame:
    """How many words of each document the mix takes (repeats counted, at most ``max_epochs`` times its words).

    ``weights`` repeat over the sources in code-point order. A source is dealt over ``shards`` shards by a seeded hash
    of the id; a block is ``1 / blocks`` of all words, one word at least. ``key`` stands for the source, null too.
    """
    rows = docs.select(
        "doc_id",
        source_key(F.col("source")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("draw"),
    ).withColumn("shard", (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % shards).cast("int"))
    cells = rows.groupBy("key", "shard").agg(F.sum("size").alias("n"))
    sources = source_targets(cells.groupBy("key").agg(F.sum("n").alias("source_size")), list(weights), max_epochs)
    sources = sources.withColumn("block", F.greatest(F.expr(f"total div {blocks}"), F.lit(1)))
    sources = apportion(sources.withColumn("seats", F.expr("total div block")), [], "target", "seats", ["key"], "source_quota")
    plan = apportion(cells.join(sources.drop("seats"), "key"), ["key"], "n", "source_quota", ["shard"], "quota")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"), F.lit("/"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    plan = plan.withColumn("first", start).select(
        "key", "shard", "n", "source_size", "target",
        F.coalesce(F.try_mod("first", F.expr("(n + block - 1) div block")) * F.col("block"), F.lit(0)).alias("a"),
        F.least(F.col("quota") * F.col("block"), F.col("n") * max_epochs).alias("words"),
    )
    stream = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("s", F.coalesce(F.sum("size").over(stream), F.lit(0))).join(plan, ["key", "shard"])

    def passed(x: Column) -> Column:
        """Words of this document before place x of the stream that repeats every n words."""
        rest = F.coalesce(F.try_mod(x, F.col("n")), F.lit(0)) - F.col("s")
        return F.coalesce(F.floor(F.try_divide(x - F.try_mod(x, F.col("n")), F.col("n"))), F.lit(0)) * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))

    return at.select(
        "doc_id", "key", "size", "source_size", "target", (passed(F.col("a") + F.col("words")) - passed(F.col("a"))).cast("long").alias("taken")
    )


def op8_mixing(docs: DataFrame) -> DataFrame:
    return mix_sources(docs).drop("key")


def _apportion_sql(members: str, by: str, weight: str, seats: str, order: str, out: str, name: str) -> str:
    """The rows of a table with the seats that each gets, as common table expressions ending in ``name``."""
    group = f"partition by {by}" if by else ""
    return f"""{name}_shares as (
  select *, coalesce({weight}::double / nullif(sum({weight}::double) over ({group}), 0), 0) as share, coalesce({weight}::double / nullif(sum({weight}::double) over ({group}), 0) * count(*) over ({group}) / 2 + 0.5, 0.5) as slack from {members}
), {name}_bounds as (
  select *, greatest(floor(share * {seats} - slack), 0)::bigint as sure, ceil(share * {seats} + slack)::bigint as most from {name}_shares
), {name}_left as (select *, {seats} - sum(sure) over ({group}) as open from {name}_bounds), {name}_seats as (
  select *, {weight}::double / (2 * seat - 1) as quotient from (select *, unnest(range(sure + 1, most + 1)) as seat from {name}_left where share > 0)
), {name}_won as (
  select *, row_number() over ({group} order by quotient desc, {order}, seat) <= open as won from {name}_seats
), {name} as (
  select m.*, case when b.share > 0 then b.sure + coalesce(w.n, 0) else 0 end::bigint as {out}
  from {members} m join {name}_bounds b using ({", ".join(dict.fromkeys(["key", *order.split(", ")]))}) left join (select {", ".join(dict.fromkeys(["key", *order.split(", ")]))}, count(*) filter (where won) as n from {name}_won group by all) w using ({", ".join(dict.fromkeys(["key", *order.split(", ")]))})
)"""


OP8_SQL = f"""
with docs as (
  select doc_id, coalesce('s' || source, 't') as key, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as size, md5('17:' || coalesce(doc_id::varchar, '')) as draw from documents
), dealt as (select *, (('0x' || substr(draw, 1, 8))::bigint % 256)::int as shard from docs),
cells as (select key, shard, sum(size)::bigint as n from dealt group by 1, 2),
sized as (select key, sum(n)::bigint as source_size, (row_number() over (order by key) - 1) % 3 as place from cells group by key),
weighed as (select *, case place when 0 then 5 when 1 then 2 else 1 end::double as weight, source_size * 3.0::double as cap, (sum(source_size) over ())::bigint as total from sized),
filled as (select *, cap / weight as ratio from weighed),
levels as (
  select *, (total - coalesce(sum(cap) over (order by ratio, key rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, key rows between current row and unbounded following) as level from filled
), sources as (
  select key, source_size, total, greatest(total // 1048576, 1) as block, total // greatest(total // 1048576, 1) as seats,
    least(cap, coalesce((select arg_min(level, struct_pack(ratio := ratio, key := key)) from levels where level <= ratio) * weight, cap)) as target from levels
), {_apportion_sql("sources", "", "target", "seats", "key", "source_quota", "shared")},
members as (select cells.key, cells.shard, cells.n, source_size, target, block, source_quota from cells join shared using (key)),
{_apportion_sql("members", "key", "n", "source_quota", "shard", "quota", "planned")},
plan as (
  select key, shard, n, source_size, target, least(quota * block, n * 3) as words,
    case when n > 0 then ('0x' || substr(md5('17/' || key || '/' || shard), 1, 8))::bigint % ((n + block - 1) // block) * block else 0 end as a from planned
), placed as (
  select *, sum(size) over (partition by key, shard order by draw, doc_id nulls first, size rows between unbounded preceding and current row) - size as s from dealt join plan using (key, shard)
)
select doc_id, size, source_size, target, case when n > 0 then
    ((a + words) // n - a // n) * size + greatest(0, least((a + words) % n - s, size)) - greatest(0, least(a % n - s, size)) else 0 end::bigint as taken
from placed
"""
