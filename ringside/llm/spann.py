"""Approximate nearest neighbours with balanced posting lists.

A bounded sample trains balanced centroids; a neighbour graph over them is searched in memory, best first, for a whole
batch of vectors at a time. A vector goes to its nearest list and, as a boundary vector, to up to ``copies`` lists
whose centroids are at most ``closure`` further. A query selects lists by distance ratio: every list up to ``ratio``
further than its nearest one, however many these are, and the ``LEAST`` nearest in any case, so that a tight clump around
one centroid doesn't end the search. A copy is skipped by queries that also look at the list where it is at home, so that
no vector is compared twice. Lists are cut in blocks, so that a hot list meets many tasks; each task keeps the best k of every query it has
met, and the results of all tasks are ranked at the end. Distances are exact, on the original vectors in double
precision.

Vectors with clusters need few lists. Without any, all centroids are about as far from a query, and the ratio selects
many lists: no index prunes such vectors at a high recall (the README has figures of both).

Vectors that are null, zero or hold null or non-finite components, and rows without an id, take no part. Vectors of
different lengths aren't compared. Ties go to the smaller id; a query's own id is no candidate. Rows that repeat an id
are candidates of their own if their vectors differ; a query id with several vectors asks with the smallest of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import cleared, shuffle_partitions, stable
from ringside.llm.vectors import blocked, fit_length, k_means, pack, squared, training_sample, unpack, usable, whole_groups, width_of


def _nearest(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the n smallest of each row, smallest first."""
    some = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(some, np.take_along_axis(d, some, axis=1).argsort(axis=1, kind="stable"), axis=1)


LEAST = 3


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    near: np.ndarray  # neighbours of each centroid
    entries: np.ndarray

    @staticmethod
    def build(centroids: np.ndarray, degree: int = 24, entries: int = 64) -> CentroidGraph:
        """Each centroid leads to its nearest ones, and to those that it is among the nearest of: what nobody is near to
        can be reached from its own neighbours."""
        k = len(centroids)
        degree = min(degree, k)
        out = np.concatenate([_nearest(squared(centroids[a : a + 2048], centroids), degree) for a in range(0, k, 2048)])
        ends, starts = out.ravel(), np.repeat(np.arange(k), degree)
        order = np.lexsort((np.tile(np.arange(degree), k), ends))  # by centroid, then by how near it is to the other
        ends, starts = ends[order], starts[order]
        place = np.arange(len(ends)) - np.searchsorted(ends, ends)
        back = np.repeat(np.arange(k)[:, None], degree, axis=1)
        back[ends[place < degree], place[place < degree]] = starts[place < degree]
        return CentroidGraph(centroids, np.concatenate([out, back], axis=1), np.linspace(0, k - 1, min(entries, k)).astype(int))

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row: ids and distances of the nearest centroids found, nearest first (id -1: none)."""
        n, k = len(x), len(self.centroids)
        beam = min(beam, k)
        at = np.arange(n)[:, None]
        seen = np.zeros((n, k + 1), dtype=bool)
        seen[:, k] = True
        ids = np.full((n, beam), k)
        dist = np.full((n, beam), np.inf)
        done = np.ones((n, beam), dtype=bool)

        def merge(new: np.ndarray) -> None:
            nonlocal ids, dist, done
            fresh = ~seen[at, new]
            order = np.sort(np.where(fresh, new, k), axis=1)
            order[:, 1:][order[:, 1:] == order[:, :-1]] = k
            seen[at, order] = True
            d = np.full(order.shape, np.inf)
            r, c = np.nonzero(order < k)
            d[r, c] = np.sqrt(((x[r] - self.centroids[order[r, c]]) ** 2).sum(axis=1))
            ids, dist = np.concatenate([ids, order], axis=1), np.concatenate([dist, d], axis=1)
            done = np.concatenate([done, order >= k], axis=1)
            best = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, done = ids[at, best], dist[at, best], done[at, best]

        merge(np.repeat(self.entries[None, :], n, axis=0))
        while not done.all():
            first = (~done).argmax(axis=1)
            go = ~done[at[:, 0], first]
            expand = np.where(go, ids[at[:, 0], first], k)
            done[at[:, 0], first] = True
            merge(np.where(go[:, None], self.near[np.minimum(expand, k - 1)], k))
        return np.where(ids < k, ids, -1), dist

    def within(self, x: np.ndarray, ratio: float, beam: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """(row, centroid) of every centroid up to ``ratio`` further than a row's nearest, and of the LEAST nearest: from
        the beam outwards over all neighbours of what is that near, until nothing new is."""
        n, k = len(x), len(self.centroids)
        dist, done = np.full((n, k), np.inf), np.zeros((n, k), dtype=bool)
        ids, d = self.search(x, beam)
        r, c = np.nonzero(ids >= 0)
        dist[r, ids[r, c]] = d[r, c]
        last = min(LEAST, k) - 1
        while True:
            limit = np.maximum((1 + ratio) * dist.min(axis=1), np.partition(dist, last, axis=1)[:, last])
            near = dist <= limit[:, None]
            r, c = np.nonzero(near & ~done)
            if not len(r):
                return np.nonzero(near)
            done[r, c] = True
            new = np.unique(np.repeat(r, self.near.shape[1]) * k + self.near[c].ravel())
            r, c = new // k, new % k
            fresh = np.isinf(dist[r, c])
            r, c = r[fresh], c[fresh]
            for a in range(0, len(r), 100_000):
                s = slice(a, a + 100_000)
                dist[r[s], c[s]] = np.sqrt(((x[r[s]] - self.centroids[c[s]]) ** 2).sum(axis=1))


#: home is the nearest list of a posting; seen marks (by bits) all lists that a query looks at.
ROW = "id long, vector binary, size int, list int, is_query boolean, home int, seen binary"


def _lists(shared, width: int, kind: str, copies: int, closure: float, ratio: float):
    """A row for each list that a vector is put in, and one for each list that a query looks at."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph: CentroidGraph = shared.value
        step = max(16, min(2000, 4_000_000 // len(graph.centroids)))
        for b in batches:
            for s in range(0, len(b), step):
                part = b.iloc[s : s + step]
                raw = [np.asarray(v, dtype=np.float64) for v in part["vector"]]
                x, asks = fit_length(raw, width), part["asks"].to_numpy().astype(bool)
                rows = part[["id", "size"]].assign(vector=pack(raw, kind))
                if asks.any():
                    who, lists = graph.within(x[asks], ratio)
                    marks = np.zeros((int(asks.sum()), len(graph.centroids)), dtype=bool)
                    marks[who, lists] = True
                    seen = np.array([m.tobytes() for m in np.packbits(marks, axis=1)], dtype=object)
                    yield rows[asks].iloc[who].assign(list=lists.astype(np.int32), is_query=True, home=np.int32(-1), seen=seen[who])
                if not asks.all():
                    ids, d = graph.search(x[~asks], max(2 * copies, 16))
                    who, col = np.nonzero((d[:, :copies] <= (1 + closure) * d[:, :1]) & (ids[:, :copies] >= 0))
                    yield rows[~asks].iloc[who].assign(list=ids[who, col].astype(np.int32), is_query=False, home=ids[who, 0].astype(np.int32), seen=None)

    return run


def _once(x: np.ndarray, y: np.ndarray, at: int, home: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Squared distances of queries and postings of one list. A copy is met only by queries that don't look at the list
    where it is at home; all other places are infinite."""
    out = np.full((len(x), len(y)), np.inf)
    for h in np.unique(home):
        cols = np.flatnonzero(home == h)
        rows = np.arange(len(x)) if h == at else np.flatnonzero((seen[:, h // 8] >> (7 - h % 8)) & 1 == 0)
        if len(rows):
            out[np.ix_(rows, cols)] = squared(x[rows], y[cols])
    return out


def _best(k: int, kind: str):
    """The best k of each query over the groups of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def told() -> pd.DataFrame:
            return pd.DataFrame([(q, int(i), float(d)) for q, (ids, ds) in kept.items() for i, d in zip(ids, ds, strict=True)], columns=["query_id", "vec_id", "score"])

        for g in whole_groups(batches, ["group"]):
            q, c = g[g["is_query"]], g[~g["is_query"]]
            if not len(q) or not len(c):
                continue
            x, y = unpack(q["vector"], kind), unpack(c["vector"], kind)
            ids = c["id"].to_numpy()
            rough = _once(x, y, g["list"].iloc[0], c["home"].to_numpy(), np.stack([np.frombuffer(b, np.uint8) for b in q["seen"]]))
            slack = 1e-9 * (1 + (y * y).sum(axis=1).max() + (x * x).sum(axis=1).max())
            for r, who in enumerate(q["id"].tolist()):
                d = np.where(ids == who, np.inf, rough[r])
                m = min(k, len(d)) - 1
                near = np.flatnonzero((d <= np.partition(d, m)[m] + slack) & (d < np.inf))
                exact = np.sqrt(((y[near] - x[r]) ** 2).sum(axis=1))
                if who in kept:
                    a, e = np.concatenate([kept[who][0], ids[near]]), np.concatenate([kept[who][1], exact])
                else:
                    a, e = ids[near], exact
                order = np.lexsort((a, e))
                a, e = a[order], e[order]
                new = np.ones(len(a), dtype=bool)  # the same vector from several lists
                new[1:] = (a[1:] != a[:-1]) | (e[1:] != e[:-1])
                kept[who] = a[new][:k], e[new][:k]
            if len(kept) > 50_000:
                yield told()
                kept.clear()
        if kept:
            yield told()

    return run


def nearest(
    rows: DataFrame,
    is_query: Column,
    k: int = 10,
    list_rows: int = 256,
    max_lists: int = 16_384,
    max_train: int = 30_000,
    copies: int = 2,
    closure: float = 0.1,
    ratio: float = 0.15,
    block: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row of (vec_id, embedding)."""
    out: DataFrame | None = None
    with cleared(rows.sparkSession, lambda: out):
        placed, kind = _placed(rows, is_query, list_rows, max_lists, max_train, copies, closure, ratio)
        dealt = blocked(placed.filter("not is_query"), placed.filter("is_query"), ["size", "list"], "id", block)
        tasks = shuffle_partitions(rows.sparkSession)
        best = dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInPandas(_best(k, kind), "query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        out = stable(best.dropDuplicates(["query_id", "vec_id", "score"]).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    return out


def _placed(rows: DataFrame, is_query: Column, list_rows: int, max_lists: int, max_train: int, copies: int, closure: float, ratio: float) -> tuple[DataFrame, str]:
    """The postings, and the lists that queries look at."""
    spark, kind = rows.sparkSession, width_of(rows)
    good = rows.filter(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col("embedding").alias("vector"))
    n = good.count()
    sample = training_sample(good, n, max_train, "vector", "id")
    graph = CentroidGraph.build(k_means(sample, max(1, min(max_lists, round(max(n / list_rows, n**0.5)))), balance=True))
    shared = spark.sparkContext.broadcast(graph)  # bounded by max_lists
    asks = good.filter("asks").groupBy("id").agg(F.min("vector").alias("vector")).withColumn("asks", F.lit(True))
    both = good.withColumn("asks", F.lit(False)).unionByName(asks).withColumn("size", F.size("vector"))
    return stable(both.mapInPandas(_lists(shared, sample.shape[1], kind, copies, closure, ratio), ROW)), kind


def scanned_share(rows: DataFrame, is_query: Column, list_rows: int = 256, max_lists: int = 16_384, max_train: int = 30_000, copies: int = 2, closure: float = 0.1, ratio: float = 0.15) -> float:
    """The mean share of all vectors that a query is compared with."""
    with cleared(rows.sparkSession):
        placed, _ = _placed(rows, is_query, list_rows, max_lists, max_train, copies, closure, ratio)
        n = placed.filter("not is_query").groupBy("list", "home").agg(F.count("*").alias("n"))
        looks = placed.filter("is_query").select("id", "list")
        met = looks.join(n, "list")
        copies_at_home = met.filter("list <> home").join(looks.select("id", F.col("list").alias("home")), ["id", "home"], "left_semi").agg(F.sum("n")).first()[0] or 0
        every = met.agg(F.sum("n").alias("n"), F.count_distinct("id").alias("asks")).first()
        return (every["n"] - copies_at_home) / max(1, every["asks"]) / placed.filter("not is_query").select("id").distinct().count()


def op7_ann(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 100 == 0)
