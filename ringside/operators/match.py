"""Joining statistics to odds: cleaned names, a band of one day, no nearest-match cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.parse import clean_name, partial_match, token_match
from ringside.operators.names import resolve, words
from ringside.operators.tables import written
from ringside.sources.bouts import drop_unnamed

c = F.col


def band_join(stats: DataFrame, odds: DataFrame, days: int = 1, how: str = "left") -> DataFrame:
    """All odds rows of the same two names within ``days`` of a bout (stats: fighter_red, fighter_blue, dt; odds: red_name,
    blue_name, odds_dt and lines).

    Each odds row stands for every date it may match, so the join is on equal keys only and a hot pair is spread
    over its dates. Odds without a date match nothing. Identical result rows are one.
    """
    keys = [clean_name(c("fighter_red")).alias("_r"), clean_name(c("fighter_blue")).alias("_b")]
    near = F.explode(F.sequence(F.date_sub("odds_dt", days), F.date_add("odds_dt", days)))
    o = drop_unnamed(odds).filter("odds_dt is not null").select(
        clean_name(c("red_name")).alias("_r"), clean_name(c("blue_name")).alias("_b"), near.alias("_d"), *[x for x in odds.columns if x not in ("red_name", "blue_name")]
    )
    s = stats.select(*stats.columns, *keys, c("dt").alias("_d"))
    return s.join(o, ["_r", "_b", "_d"], how).drop("_r", "_b", "_d").dropDuplicates()


def names_only_join(stats: DataFrame, odds: DataFrame) -> DataFrame:
    """Inner join on both names, dates ignored."""
    return stats.join(odds, (c("fighter_red") == c("red_name")) & (c("fighter_blue") == c("blue_name")))


def match_names(left: DataFrame, right: DataFrame, by: str, a: str, b: str, tokens: bool = True, block: int = 5_000) -> DataFrame:
    """Candidate pairs of names of one card (equal ``by``): by words, or by characters as the looser rule.

    Words are looked up in an index of the distinct names. By characters, only the sets of characters matter: the rule compares each
    two distinct sets once. Both sides of a card meet as lists by set, so that each name is sent once, not once for every set that fits;
    what a card has is cut in blocks of about ``block`` names.
    """
    if tokens:
        fits = resolve(left, right, a, b).unionByName(_wordless(left, right, a, b))
        return left.join(fits, a).join(right, [by, b]).select(*left.columns, *[x for x in right.columns if x != by])
    kind = lambda x: F.array_join(F.array_sort(F.array_distinct(F.split(x, ""))), "")
    kinds = lambda t, x, name: t.select(kind(c(x)).alias(name)).filter(c(name).isNotNull()).distinct()
    line = Window.orderBy("_b")  # over one row a set of characters
    numbers, _ = written(kinds(right, b, "_b").withColumn("_n", F.row_number().over(line)))
    fits = kinds(left, a, "_a").join(numbers, partial_match(c("_a"), c("_b"))).groupBy("_a").agg(F.collect_list("_n").alias("_fit"))
    others = [x for x in right.columns if x != by]
    size = right.groupBy(by).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    dealt = right.withColumn("_b", kind(c(b))).join(numbers, "_b").join(size, by).withColumn("_block", F.pmod(F.xxhash64(b), c("_blocks")))
    there = dealt.groupBy(by, "_block", "_n").agg(F.collect_list(F.struct(*others)).alias("_right")).groupBy(by, "_block").agg(F.collect_list(F.struct("_n", "_right")).alias("_kinds"))
    here = left.withColumn("_a", kind(c(a))).groupBy(by, "_a").agg(F.collect_list(F.struct(*[x for x in left.columns if x != by])).alias("_left")).join(fits, "_a")
    met = here.join(there, by).select(by, "_left", F.explode(F.filter("_kinds", lambda k: F.array_contains("_fit", k["_n"]))).alias("_hit"))
    found = met.select(by, F.explode("_left").alias("_l"), c("_hit._right").alias("_right")).select(by, "_l", F.explode("_right").alias("_r"))
    return found.select(*[c(by) if x == by else c(f"_l.{x}") for x in left.columns], *[c(f"_r.{x}") for x in others])


def _wordless(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs that fit because one of the names has no word, which the index leaves out."""
    side = lambda t, x: t.select(x).distinct().withColumn(f"_none_{x}", F.size(words(c(x))) == 0)
    one, two = side(left, a), side(right, b)
    some = one.filter(f"`_none_{a}`").join(two).unionByName(one.filter(f"not `_none_{a}`").join(two.filter(f"`_none_{b}`")))
    return some.select(a, b).filter(token_match(c(a), c(b)))


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi-join on one or more keys; other columns that both sides have get a suffix each."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, end: df.select(*[c(x).alias(x + end) if x in both else c(x) for x in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), on, how)


def look_up(rows: DataFrame, names: DataFrame, key: str, default: str | None = None) -> DataFrame:
    """The column ``value`` of a table (key, value) for each row; what isn't in it gets the default column or NULL."""
    found = rows.join(names.select(c("key").alias(key), "value"), key, "left")
    return found.withColumn("value", F.coalesce("value", default)) if default else found
