"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """What the setting names; a folder of this machine only where Spark runs on this machine alone."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"set {SETTING} to a folder that all executors of {master} share")
    return os.path.join(tempfile.gettempdir(), "ringside-tables")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """The table as read from where it was written, and its path: a lost executor repeats nothing that came before."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def quantile(rows: DataFrame, column: str, q: float, slack: float = 1e-3) -> float | None:
    """The exact quantile of a column of doubles (between two ranks by their distance, as F.percentile has it); NULL if all are.

    F.percentile gathers every distinct value in one task. Here a sketch bounds the wanted ranks from both sides, and only values
    inside the bounds (about 4 ``slack`` of them) are counted and ordered. Rows are scanned three times, so they
    should be kept."""
    known = rows.select(F.col(column).alias("v")).filter("v is not null")
    n = known.count()
    if not n:
        return None
    far = 2 * slack + 2 / n
    low, high = known.approxQuantile("v", [max(0.0, q - far), min(1.0, q + far)], slack)
    below = known.filter(F.col("v") < low).count()
    at = q * (n - 1)
    wanted = [math.floor(at), math.ceil(at)]
    values = known.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("k"))
    last = F.sum("k").over(Window.orderBy("v")) + below  # one row a value inside the bounds
    found = values.select("v", (last - F.col("k")).alias("first"), last.alias("behind"))
    a, b = (found.filter((F.col("first") <= r) & (F.col("behind") > r)).first()["v"] for r in wanted)
    return a if wanted[0] == wanted[1] else (wanted[1] - at) * a + (at - wanted[0]) * b
