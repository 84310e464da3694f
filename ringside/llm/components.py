"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ringside.llm.common import drop, stable


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b); component is the smallest id that can be reached.

    Each round points every node at its smallest neighbour, follows pointers to their roots by doubling, renames the
    ends of all edges to the roots and drops loops and repeats. A root stands for two nodes at least, so n nodes need at
    most log2(n) rounds of at most log2(n) doublings; a path that is numbered in order takes one round. Every step is a
    table in the shared folder, so that plans and their size estimates stay small however many rounds a graph takes.

    Nulls and loops are not edges. A node with very many edges is a skewed join key, nothing more: only minima are taken
    over its edges.
    """
    left = stable(_tidy(edges.select("a", "b")))
    names: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = _roots(stable(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))))
        if names is None:
            named = stable(point.withColumnRenamed("to", "component"))
        else:
            moved = point.select(F.col("id").alias("component"), "to")
            named = stable(names.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component")))
        a, b = (point.select(F.col("id").alias(x), F.col("to").alias(f"new_{x}")) for x in "ab")
        rest = stable(_tidy(left.join(a, "a").join(b, "b").select(F.col("new_a").alias("a"), F.col("new_b").alias("b"))))
        drop(left, names, point)
        left, names = rest, named
    if names is None:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    drop(left)
    return names


def _roots(point: DataFrame) -> DataFrame:
    """Follow pointers (id, to) until all of them end at a node that points at itself."""
    while True:
        onward = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
        seen = Observation()
        moved = point.join(onward, "to").select("id", "to", "next").observe(seen, F.count_if(F.col("to") != F.col("next")).alias("n"))
        further = stable(moved.select("id", F.col("next").alias("to")))
        drop(point)
        point = further
        if not seen.get["n"]:
            return point


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
