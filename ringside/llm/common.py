"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where Spark runs on one machine is a folder of that machine good enough;
    a cluster has to name one."""
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"set {SETTING} to a folder that all executors of {master} share")
    return os.path.join(tempfile.gettempdir(), "ringside-tables")


#: Folders of the tables that stable() wrote inside the innermost cleared() of this thread and nothing has removed yet.
_scope: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables of this call", default=None)


def stable(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: a lost executor repeats nothing that came before, and the
    optimiser's size estimates start anew from the files. ``remove`` or ``cleared`` delete the table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stable_at = path
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders wherever Spark can write."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in (scope := _scope.get() or []):
            scope.remove(path)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that stable() wrote and that nothing will read any more."""
    for t in tables:
        if getattr(t, "_stable_at", None):
            remove(t.sparkSession, t._stable_at)


@contextlib.contextmanager
def cleared(spark: SparkSession, keep: Callable[[], DataFrame | None] = lambda: None) -> Iterator[None]:
    """At the end, delete the tables that stable() wrote inside, in this thread, except the one that ``keep`` names:
    that one passes to the call around this one, if there is any."""
    outer, own = _scope.get(), []
    token = _scope.set(own)
    try:
        yield
    finally:
        kept = getattr(keep(), "_stable_at", None)
        remove(spark, *[p for p in list(own) if p != kept])
        _scope.reset(token)
        if outer is not None and kept in own:
            outer.append(kept)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


In, Out = TypeVar("In"), TypeVar("Out")


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[In]], Iterator[Out]]) -> Callable[[Iterator[In]], Iterator[Out]]:
    """Give freed memory back to the system when a task ends: Spark reuses Python workers, and what one stage needed at
    its peak would otherwise stay with them through the next ones."""

    def wrapped(batches: Iterator[In]) -> Iterator[Out]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
