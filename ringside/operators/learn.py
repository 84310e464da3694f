"""Win models and clusters with pyspark.ml, fitted on the chronological training part only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, MinMaxScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.market import movement
from ringside.operators.audit import chronological_split
from ringside.operators.forest import without_outliers
from ringside.operators.history import decided_differences, feature_table
from ringside.operators.market import choices
from ringside.operators.neighbours import exact_nearest
from ringside.operators.penalised import Setting, fit_many, parzen_search, stratified_folds
from ringside.operators.tables import quantile, written
from ringside.operators.towers import fit_towers, rated

c = F.col
FEATURES = [
    "num_wins_diff", "num_losses_diff", "win_streak_diff", "lose_streak_diff", "win_pct_diff", "sig_str_landed_pm_diff", "sig_str_absorbed_pm_diff", "td_landed_pm_diff", "control_pm_diff", "kd_pm_diff",
    "ko_wins_diff", "sub_wins_diff", "total_fight_time_diff",
]
STRENGTHS = tuple(10 ** (-4 + k / 33) for k in range(100))


def training_frame(bouts: DataFrame) -> DataFrame:
    """Decided bouts with pre-fight differences, y (red won), weight class and the chronological split. The bouts are scanned once and the
    frame is written; fits, and the split itself, scan what was written."""
    known = decided_differences(bouts, ("sig_str_landed", "sig_str_absorbed", "td_landed", "control", "kd"))
    frame, _ = written(known.select("bout_id", "dt", "weight_class", c("won").cast("double").alias("y"), *FEATURES).na.fill(0.0, FEATURES))
    return chronological_split(frame).drop("dt")


def scaled(frame: DataFrame, features: list[str] = FEATURES, k: int | None = None, unit: bool = False) -> tuple[Pipeline, DataFrame]:
    """Encoded weight class, assembler, scaler (by deviation, or to [0, 1]) and optionally PCA, fitted on the training
    part, and the transformed frame."""
    stages = [
        StringIndexer(inputCol="weight_class", outputCol="class_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
        VectorAssembler(inputCols=[*features, "class_index"], outputCol="raw"),
        MinMaxScaler(inputCol="raw", outputCol="x") if unit else StandardScaler(inputCol="raw", outputCol="x", withMean=True),
    ]
    if k:
        stages.append(PCA(k=k, inputCol="x", outputCol="pca"))
    model = Pipeline(stages=stages).fit(frame.filter("is_train"))
    return model, model.transform(frame)


def _p(df: DataFrame) -> DataFrame:
    return df.withColumn("p", vector_to_array("probability")[1])


def logistic(bouts: DataFrame) -> DataFrame:
    """bout_id, y, p of the held-out part."""
    _, x = scaled(training_frame(bouts))
    model = LogisticRegression(featuresCol="x", labelCol="y").fit(x.filter("is_train"))
    return _p(model.transform(x.filter("not is_train"))).select("bout_id", "y", "p")


def boosted(bouts: DataFrame, trees: int = 20) -> DataFrame:
    _, x = scaled(training_frame(bouts))
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=3, seed=1).fit(x.filter("is_train"))
    return _p(model.transform(x.filter("not is_train"))).select("bout_id", "y", "p")


def _dense(x: DataFrame) -> DataFrame:
    """(bout_id, x array, y) of a transformed frame."""
    return x.select("bout_id", vector_to_array("x").alias("x"), "y")


def l1_path(bouts: DataFrame, strengths: tuple[float, ...] = STRENGTHS) -> DataFrame:
    """For each feature the first strength of the L1 path (weak to strong) from which its coefficient stays zero, and
    its rank: what vanishes last matters most. All strengths are fitted in the same scans."""
    _, x = scaled(training_frame(bouts))
    rows = _dense(x.filter("is_train")).withColumn("fold", F.lit(-2))
    names = [*FEATURES, "class_index"]
    beta, _ = fit_many(rows, [Setting(s, 0.0) for s in strengths], len(names))
    path = [(f, k, float(beta[k, j])) for j, f in enumerate(names) for k in range(len(strengths))]
    gone = bouts.sparkSession.createDataFrame(path, "feature string, step int, coefficient double").groupBy("feature")
    vanish = gone.agg((F.coalesce(F.max(F.when(c("coefficient") != 0, c("step"))), F.lit(-1)) + 1).alias("vanish"))
    return vanish.withColumn("rank", F.rank().over(Window.orderBy(c("vanish").desc())))


def searched(bouts: DataFrame, trials: int = 50, folds: int = 15) -> DataFrame:
    """Logistic settings proposed by Parzen estimates and scored by macro F1 on stratified folds: trial, reg, elastic,
    macro_f1, best first. Rows are dealt to folds before they are scaled, and written; scans scale them where they lie."""
    frame = training_frame(bouts)
    model, _ = scaled(frame)
    dealt, _ = written(stratified_folds(frame.filter("is_train").drop("is_train"), folds))
    rows = model.transform(dealt).select(vector_to_array("x").alias("x"), "y", "fold")
    found = parzen_search(rows, len(FEATURES) + 1, trials, folds)
    return bouts.sparkSession.createDataFrame(found, "trial int, reg double, elastic double, macro_f1 double").orderBy(c("macro_f1").desc(), "trial")


def isolated(bouts: DataFrame, contamination: float = 0.05) -> DataFrame:
    """bout_id, score and outlier of training bouts by an isolation forest."""
    _, x = scaled(training_frame(bouts))
    rows = _dense(x.filter("is_train")).select(c("bout_id").alias("id"), "x")
    return without_outliers(rows, contamination).withColumnRenamed("id", "bout_id")


CORNER = tuple(x.removesuffix("_diff") for x in FEATURES)


def two_towers(bouts: DataFrame, hidden: int = 8, steps: int = 30) -> DataFrame:
    """bout_id, y, p of the held-out part, by a network that rates both corners alike from their own features. The frame is computed
    once and kept (in memory or on disk) until the session's cache is cleared; every scan of the fit reads it."""
    split = chronological_split(bouts.filter("winner in (0, 1)")).select("bout_id", c("winner").cast("int").alias("y"), "is_train")
    names = [f"{x}_{k}" for k in ("red", "blue") for x in CORNER]
    frame = split.join(feature_table(bouts).select("bout_id", *names), "bout_id").na.fill(0, names).persist()
    spread = frame.filter("is_train").agg(*[f(x).alias(f"{n}_{x}") for x in names for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()  # one row
    both = lambda n, x: float(np.mean([spread[f"{n}_{x}_{k}"] or 0.0 for k in ("red", "blue")]))
    scale = {x: (both("m", x), both("s", x) or 1.0) for x in CORNER}
    x = F.array(*[(c(f"{n}_{k}") - scale[n][0]) / scale[n][1] for k in ("red", "blue") for n in CORNER]).alias("x")
    rows = frame.select("bout_id", "y", "is_train", x, F.lit(0).alias("fold"))
    net, w = fit_towers(rows.filter("is_train"), len(CORNER), hidden, steps=steps)
    return rated(rows.filter("not is_train"), net, w).select("bout_id", c("y").cast("double").alias("y"), "p")


def platt(bouts: DataFrame) -> DataFrame:
    """The raw model probability and its logistic calibration, fitted on the training part: bout_id, y, raw, p."""
    frame = chronological_split(bouts.filter("winner in (0, 1)")).select("bout_id", c("winner").cast("double").alias("y"), "is_train", c("p_red").alias("raw"), (1 - c("p_red")).alias("raw_blue"))
    x = VectorAssembler(inputCols=["raw", "raw_blue"], outputCol="x").transform(frame)
    model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1e-6).fit(x.filter("is_train"))
    return _p(model.transform(x.filter("not is_train"))).select("bout_id", "y", "raw", "p")


def explained_variance(bouts: DataFrame, k: int = 5, unit: bool = False) -> DataFrame:
    """Share of the variance that each principal component holds, and their running sum: component, share, total."""
    model, _ = scaled(training_frame(bouts), k=k, unit=unit)
    shares = [float(v) for v in model.stages[-1].explainedVariance]
    rows = [(i + 1, v, sum(shares[: i + 1])) for i, v in enumerate(shares)]
    return bouts.sparkSession.createDataFrame(rows, "component int, share double, total double")


def outliers(bouts: DataFrame, k: int = 2, q: float = 0.985) -> DataFrame:
    """Rows whose error of PCA reconstruction is above the quantile ``q`` of the training part: bout_id, error."""
    model, x = scaled(training_frame(bouts), k=k)
    axes = model.stages[-1].pc.toArray()  # features x k
    v, z = vector_to_array("x"), vector_to_array("pca")
    back = F.array(*[sum((z[j] * float(axes[i, j]) for j in range(k)), F.lit(0.0)) for i in range(len(axes))])
    err = F.aggregate(F.zip_with(v, back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    x = x.select("bout_id", "is_train", err.alias("error")).persist()  # until the session's cache is cleared
    cut = quantile(x.filter("is_train"), "error", q)
    return x.filter(c("error") > F.lit(cut)).select("bout_id", "error")


def _points(d: DataFrame, features: list[str], **sums: Column) -> DataFrame:
    """Distinct points (scaled to unit deviation, ``x``) with ``weight``, how many rows lie there, and sums over these. Fits take the
    weights, so that they scan the places that occur, not the rows. The table is written once, and every scan reads it."""
    told, _ = written(d.groupBy(*features).agg(F.count("*").cast("double").alias("weight"), *[F.sum(v).alias(k) for k, v in sums.items()]))
    mean = told.agg(F.sum("weight").alias("n"), *[(F.sum(c(f) * c("weight")) / F.sum("weight")).alias(f) for f in features]).first()  # one row
    far = told.agg(*[F.sum(c("weight") * F.pow(c(f) - mean[f], 2)).alias(f) for f in features]).first()  # one row
    sd = {f: float(np.sqrt((far[f] or 0.0) / max((mean["n"] or 0.0) - 1, 1))) for f in features}
    z = told.withColumns({f"_{f}": (c(f) - mean[f]) / sd[f] if sd[f] else F.lit(0.0) for f in features})
    return VectorAssembler(inputCols=[f"_{f}" for f in features], outputCol="x").transform(z).select("x", "weight", *sums)


def cluster_units(bouts: DataFrame, k: int = 7, mixture: bool = False) -> DataFrame:
    """Net units and picks by cluster of (odds, probability) of picks."""
    x = _points(choices(bouts), ["choice_dec_open", "choice_dec_close1", "choice_prob"], units=c("net_close1"), right=c("correct"))
    kind = GaussianMixture if mixture else KMeans
    done = kind(featuresCol="x", weightCol="weight", k=k, seed=1, predictionCol="cluster").fit(x).transform(x)
    return done.groupBy("cluster").agg(F.sum("weight").cast("long").alias("n"), F.sum("units").alias("units"), (F.sum("right") / F.sum("weight")).alias("accuracy"))


def cluster_odds(bouts: DataFrame, k: int = 25, line: str = "close1") -> DataFrame:
    """Clusters of both corners' decimal odds: bouts, and mean units of the pick in each (net odds, or -1)."""
    odds = [f"dec_{line}_red", f"dec_{line}_blue"]
    x = _points(choices(bouts, tuple(odds)), odds, units=c(f"net_{line}"))
    done = KMeans(featuresCol="x", weightCol="weight", k=k, seed=1, predictionCol="cluster").fit(x).transform(x)
    return done.groupBy("cluster").agg(F.sum("weight").cast("long").alias("n"), (F.sum("units") / F.sum("weight")).alias("mean_units"))


def mixture_bic(bouts: DataFrame, ks: tuple[int, ...] = tuple(range(9, 20))) -> DataFrame:
    """k, bic of Gaussian mixtures over (probability, odds) of picks; the smallest is best."""
    x = _points(choices(bouts), ["choice_dec_close1", "choice_prob"])
    n = x.agg(F.sum("weight")).first()[0]
    rows = []
    for k in ks:
        ll = GaussianMixture(featuresCol="x", weightCol="weight", k=k, seed=1, maxIter=20).fit(x).summary.logLikelihood
        free = k - 1 + k * 2 + k * 3
        rows.append((k, float(free * np.log(n) - 2 * ll)))
    return bouts.sparkSession.createDataFrame(rows, "k int, bic double").orderBy("bic")


def nearest_bouts(bouts: DataFrame, k: int = 5, components: int = 2, block: int = 20_000, chunk: int = 20_000) -> DataFrame:
    """For each held-out bout the k training bouts that are nearest in scaled PCA space, of all of them and of each class of line
    movement (cohort): exact Euclidean."""
    _, x = scaled(training_frame(bouts), k=components)
    flags = movement(c("choice_open"), c("choice_close1"))
    kind = F.coalesce(*[F.when(f == 1, name) for name, f in flags.items()], F.lit("other")).alias("cohort")
    z = x.select("bout_id", "is_train", vector_to_array("pca").alias("z")).join(choices(bouts).select("bout_id", kind), "bout_id")
    parts = lambda *names: F.explode(F.array(*names)).alias("part")
    history = z.filter("is_train").select(c("bout_id").alias("id"), "z", parts(F.lit("entire_history"), c("cohort")))
    asked = z.filter("not is_train").select(c("bout_id").alias("id"), "z", parts(*map(F.lit, ("entire_history", *flags, "other"))))
    found = exact_nearest(history, asked, k, block=block, chunk=chunk)
    return found.select(c("id").alias("bout_id"), c("part").alias("cohort"), "near_id", "distance", "rank")
