"""Which spellings of names may mean the same person: an inverted index of words or q-grams instead of all pairs.

A name fits another one if every word of one stands in the other (or a share of its q-grams does). Then at least
``share`` of the words (q-grams) of the one stand in the other, so one of its rarest ``n - ceil(share * n) + 1`` has to. Only
these are looked up among all of the other side; what meets is counted (the count filter), and what passes is checked by
the rule itself. Frequent ones, as endings that many names share, are thus looked up only by names that have nothing
rarer. Where whole words have to fit, whole words are the index: the number of q-grams is bounded, so that each would
meet the more names the more there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.parse import clean_name, token_match

c = F.col


def words(name: Column) -> Column:
    """Distinct words of a cleaned name."""
    return F.array_distinct(F.filter(F.split(clean_name(name), r"\s+"), lambda w: w != ""))


def grams(name: Column, q: int = 3) -> Column:
    """Distinct q-grams of the words of a cleaned name, with marks at both ends of a word."""
    marked = F.transform(words(name), lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - q + 1, F.lit(1))), lambda k: F.substring(w, k, q))
    return F.array_distinct(F.flatten(F.transform(marked, cut)))


def _contained(a: DataFrame, b: DataFrame, by: list[str], frequency: DataFrame, share: float) -> DataFrame:
    """Pairs (x of a, x of b) of which a's grams stand in b's up to the share."""
    single = lambda t: t.select(*by, "x", "g", F.explode("g").alias("gram"))
    rarest = Window.partitionBy(*by, "x").orderBy("n", "gram")
    least = F.ceil(F.size("g") * F.lit(share))
    asked = single(a).join(frequency, "gram").withColumn("place", F.row_number().over(rarest)).filter(c("place") <= F.size("g") - least + 1)
    met = asked.select(*by, "gram", c("x").alias("xa"), c("g").alias("ga")).join(single(b).select(*by, "gram", c("x").alias("xb"), c("g").alias("gb")), [*by, "gram"])
    enough = F.size(F.array_intersect("ga", "gb")) >= F.ceil(F.size("ga") * F.lit(share))
    return met.filter(enough).select(*by, "xa", "xb").distinct()


def resolve(left: DataFrame, right: DataFrame, a: str, b: str, by: list[str] | None = None, q: int = 3, share: float = 1.0) -> DataFrame:
    """Distinct (by, a, b) of names of both sides, equal in ``by``, that fit. With ``share`` 1 every word of one name has to
    stand in the other; below 1 that share of its q-grams, so that a slip of the pen still fits. NULLs fit nothing."""
    by = by or []
    if by and share >= 1:  # whether two names fit doesn't depend on ``by``, and distinct names are far fewer than rows of it
        fits = resolve(left, right, a, b)
        of = lambda t, x: t.select(*by, x).distinct()
        return of(left, a).join(fits, a).join(of(right, b), [*by, b]).select(*by, a, b)
    index = words(c("x")) if share >= 1 else grams(c("x"), q)
    side = lambda t, x: t.filter(c(x).isNotNull()).select(*by, c(x).alias("x")).distinct().withColumn("g", index).filter(F.size("g") > 0)
    one, two = side(left, a), side(right, b)
    counted = lambda t: t.select(F.explode("g").alias("gram"))
    frequency = counted(one).unionByName(counted(two)).groupBy("gram").agg(F.count("*").alias("n"))
    there = _contained(one, two, by, frequency, share).select(*by, c("xa").alias(a), c("xb").alias(b))
    back = _contained(two, one, by, frequency, share).select(*by, c("xb").alias(a), c("xa").alias(b))
    pairs = there.unionByName(back).distinct()
    return pairs.filter(token_match(c(a), c(b))) if share >= 1 else pairs
