"""Isolation forest: rows that random cuts set apart early are outliers.

Every tree grows in a group of its own on a hashed sample of rows, so trees grow side by side; each is one row of a
small table (trees times nodes, whatever the input). Scoring walks all trees for a batch of rows at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.tables import quantile

c = F.col
TREE = "tree int, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"


def usual_length(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 2:
        return max(0.0, n - 1.0)
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> dict[str, list]:
    """Nodes of one tree: a feature and a cut each, or -1 and the path length of a leaf."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "length")}

    def node(rows: np.ndarray, level: int) -> int:
        at = len(nodes["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", at), ("right", at), ("length", level + usual_length(len(rows)))):
            nodes[k].append(v)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if level < depth and len(rows) > 1 and len(open_):
            f = int(rng.choice(open_))
            cut = float(rng.uniform(low[f], high[f]))
            below = x[rows, f] < cut
            nodes["feature"][at], nodes["cut"][at] = f, cut
            nodes["left"][at], nodes["right"][at] = node(rows[below], level + 1), node(rows[~below], level + 1)
        return at

    node(np.arange(len(x)), 0)
    return nodes


def isolation_trees(rows: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """One row a tree, grown on about ``sample`` of the rows (id, x array<double>), chosen by a hash of id and tree."""
    share = min(1.0, sample / max(rows.count(), 1))
    depth = math.ceil(math.log2(max(sample, 2)))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = np.stack(group.sort_values("id")["x"])
        return pd.DataFrame([{"tree": tree, **grow(x, depth, np.random.default_rng([seed, tree]))}])

    return rows.select("id", "x", F.explode(drawn).alias("tree")).groupBy("tree").applyInPandas(one, TREE)


def path_lengths(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """How deep each row falls in each tree, summed over the trees."""
    total, every = np.zeros(len(x)), np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int64)
        open_ = every[t["feature"][at] >= 0]
        while len(open_):
            node = at[open_]
            low = x[open_, t["feature"][node]] < t["cut"][node]
            at[open_] = node = np.where(low, t["left"][node], t["right"][node])
            open_ = open_[t["feature"][node] >= 0]
        total += t["length"][at]
    return total


def isolation_scores(rows: DataFrame, fitted: DataFrame, sample: int = 256) -> DataFrame:
    """id and score (0 to 1, higher: set apart sooner) of every row. The trees (``trees`` times nodes, whatever the input) are
    collected like any fitted model; rows walk them batch by batch."""
    found = fitted.orderBy("tree").collect()
    trees = [{k: np.array(r[k], dtype=float if k in ("cut", "length") else np.int64) for k in ("feature", "cut", "left", "right", "length")} for r in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mean = path_lengths(trees, np.stack(b["x"])) / len(trees) if len(b) else np.zeros(0)
            yield pd.DataFrame({"id": b["id"], "score": 2.0 ** (-mean / usual_length(sample))})

    return rows.select("id", "x").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def without_outliers(rows: DataFrame, contamination: float = 0.05, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(id, score, outlier): the ``contamination`` share of rows with the highest scores are outliers. Scores are kept (in memory
    or on disk) until the session's cache is cleared."""
    scored = isolation_scores(rows, isolation_trees(rows, trees, sample, seed), sample).persist()
    cut = quantile(scored, "score", 1 - contamination)
    return scored.select("id", "score", (c("score") > F.lit(cut)).alias("outlier"))
