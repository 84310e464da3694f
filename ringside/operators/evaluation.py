"""How good predictions are: grouped accuracy, proper scores, calibration, AUC, intervals of bins."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
TINY = 1e-12


def accuracy_by(df: DataFrame, bucket: Column, correct: str = "correct") -> DataFrame:
    return df.groupBy(bucket.alias("bucket")).agg(F.avg(correct).alias("accuracy"), F.count("*").alias("n"))


def accuracy_by_each(df: DataFrame, buckets: dict[str, Column], correct: str = "correct") -> DataFrame:
    """Accuracy by every one of several buckets, in one pass: kind, bucket, accuracy, n."""
    every = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("bucket")) for k, v in buckets.items()])
    return df.select(c(correct), F.inline(every)).groupBy("kind", "bucket").agg(F.avg(correct).alias("accuracy"), F.count("*").alias("n"))


def with_mistakes(df: DataFrame, predicted: str, actual: str, p: str, sure: float = 0.7) -> DataFrame:
    """Flags to filter cohorts by: a wrong pick, which way it was wrong, and whether it was a sure one (p: of the pick)."""
    wrong = c(predicted) != c(actual)
    flag = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    return df.withColumns({
        "wrong": flag(wrong), "false_positive": flag(wrong & (c(predicted) == 1)), "false_negative": flag(wrong & (c(predicted) == 0)), "sure_mistake": flag(wrong & (c(p) >= sure)),
    })


def proper_scores(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    q = F.greatest(F.lit(TINY), F.least(F.lit(1 - TINY), c(p)))
    return df.agg(F.avg(F.pow(c(p) - c(y), 2)).alias("brier"), F.avg(-(c(y) * F.ln(q) + (1 - c(y)) * F.ln(1 - q))).alias("logloss"), F.count("*").alias("n"))


def calibration(df: DataFrame, bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    b = F.least(F.floor(c(p) * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(p).alias("mean_p"), F.avg(y).alias("share"), F.count("*").alias("n"))


def auc(df: DataFrame, p: str = "p", y: str = "y", digits: int = 6) -> DataFrame:
    """Area under the ROC curve by rank sums, ties counted half. Scores are rounded to ``digits`` first, so that the
    running sum sorts 10 ** digits rows at most."""
    v = df.groupBy(F.round(p, digits).alias("v")).agg(F.sum(y).alias("pos"), F.count("*").alias("n")).withColumn("neg", c("n") - c("pos"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = v.select("pos", "neg", (c("pos") * (below + c("neg") / 2)).alias("won"))
    return pairs.agg((F.sum("won") / (F.sum("pos") * F.sum("neg"))).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    return df.groupBy(predicted, actual).agg(F.count("*").alias("n"))


def _beta_fraction(a: float, b: float, x: float, terms: int = 300) -> float:
    """The continued fraction of the incomplete beta function, from the innermost term outwards."""
    value = 1.0
    for k in range(terms, 0, -1):
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1 + d / (value or 1e-300)
    return 1 / value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2) and (b, 1 - x) != (a, x):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))) / a
    return front * _beta_fraction(a, b, x)


def t_above(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        m = (low + high) / 2
        low, high = (m, high) if t_above(m, df) > 1 - p else (low, m)
    return (low + high) / 2


def bin_intervals(df: DataFrame, bin_col: Column, value: str, level: float = 0.95) -> DataFrame:
    """By bin: n, mean, sample deviation, standard error, t interval, and the one-sided p-value of a mean above 0."""
    stats = df.groupBy(bin_col.alias("bin")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    stats = stats.withColumn("se", c("sd") / F.sqrt("n"))

    @F.pandas_udf("half double, p_value double")
    def tails(n: pd.Series, mean: pd.Series, se: pd.Series) -> pd.DataFrame:
        rows = [(t_quantile((1 + level) / 2, k - 1) * e, t_above(m / e, k - 1)) if k > 1 and e > 0 else (None, None) for k, m, e in zip(n, mean, se, strict=True)]
        return pd.DataFrame(rows, columns=["half", "p_value"])

    done = stats.withColumn("t", tails("n", "mean", "se"))
    return done.select("bin", "n", "mean", "sd", "se", (c("mean") - c("t.half")).alias("low"), (c("mean") + c("t.half")).alias("high"), c("t.p_value").alias("p_value"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))


def mutual_information(df: DataFrame, features: dict[str, Column], y: str) -> DataFrame:
    """Mutual information (nats) of each binned feature with a label, from joint counts; the ranking of a relevance filter."""
    long = df.select(c(y).alias("y"), F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("string").alias("x")) for k, v in features.items()])))
    joint = long.groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("feature", *by))
    part = joint.select("feature", "n", total("x").alias("nx"), total("y").alias("ny"), total().alias("all"))
    return part.groupBy("feature").agg(F.sum(c("n") / c("all") * F.ln(c("n") * c("all") / (c("nx") * c("ny")))).alias("mi"))


def pairwise_information(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Mutual information (nats) of every two binned features, from joint counts in one pass: a, b (a before b), mi."""
    names = sorted(features)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    binned = df.select(*[features[n].cast("string").alias(n) for n in names])
    each = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(a).alias("x"), c(b).alias("y")) for a, b in pairs])
    joint = binned.groupBy(*names).agg(F.count("*").alias("n")).select("n", F.inline(each)).groupBy("a", "b", "x", "y").agg(F.sum("n").alias("n"))
    total = lambda *by: F.sum("n").over(Window.partitionBy("a", "b", *by))
    part = joint.select("a", "b", "n", total("x").alias("nx"), total("y").alias("ny"), total().alias("all"))
    return part.groupBy("a", "b").agg(F.sum(c("n") / c("all") * F.ln(c("n") * c("all") / (c("nx") * c("ny")))).alias("mi"))


def mrmr(df: DataFrame, features: dict[str, Column], y: str, most: int) -> DataFrame:
    """Features in the order of largest relevance less mean redundancy: feature, rank, score. The choice is made on the
    table of informations, one number for every two features."""
    label = "\0label"
    table = {(r["a"], r["b"]): r["mi"] for r in pairwise_information(df, features | {label: c(y)}).collect()}
    mi = lambda a, b: table[min(a, b), max(a, b)]
    left, chosen, rows = sorted(features), [], []
    while left and len(chosen) < most:
        score = {f: mi(f, label) - (sum(mi(f, g) for g in chosen) / len(chosen) if chosen else 0.0) for f in left}
        best = min(left, key=lambda f: (-round(score[f], 9), f))  # ties: by name
        chosen.append(best)
        left.remove(best)
        rows.append((best, len(chosen), float(score[best])))
    return df.sparkSession.createDataFrame(rows, "feature string, rank int, score double")
