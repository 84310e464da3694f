"""Near-duplicate vectors by product quantisation.

Equal vectors of a label are first counted as one. A bounded sample trains coarse centroids and, on residuals to them,
codebooks of subspaces. Every vector is put in the inverted list of its nearest centroid with its code and the error
of that code. Of two vectors in different lists, the one of the later list probes the earlier one, if a partner at the
largest allowed distance can lie there: whatever is nearest to another centroid is so far away at least as the plane
between that centroid and the own one, and as the plane between it and the mean of the nearest centroids. So probes are
sufficient: no partner is lost, and each pair meets once and counts for both. In a list, asymmetric table-lookup
distances drop whatever is further than that distance plus the code's error, which loses no partner either (triangle
inequality), and exact cosines in double precision decide.

Lists are cut in blocks on both sides, so that a hot list never meets in one task; a block returns counts and a
spanning forest of its links of bounded degree, not the pairs. Counting all links of m different vectors in one list
looks at m * m / 2 codes. Vectors without clusters are near every border: they probe most earlier lists, and no exact
method is known to do better.

Vectors that are null, zero or hold null or non-finite components, and rows of null label, link with nothing. Vectors
of different lengths don't link; those of another length than the commonest share one list for each label and length.
Rows that repeat an id are rows of their own, linked if their vectors link, and so are rows without an id: these never
name a component unless all of it has none, and are kept only then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import cleared, shuffle_partitions, stable
from ringside.llm.components import connected_components
from ringside.llm.vectors import blocked, k_means, pack, squared, training_sample, unit, unpack, usable, whole_groups, width_of


@dataclass
class Codebook:
    centroids: np.ndarray
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centroids.shape[1]

    @staticmethod
    def train(sample: np.ndarray, lists: int, subspaces: int, words: int) -> Codebook:
        centroids = k_means(sample, lists)
        residual = sample - centroids[squared(sample, centroids).argmin(axis=1)] if len(sample) else sample
        edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        return Codebook(centroids, cuts, [k_means(residual[:, a:b], words, seed=a) for a, b in cuts])

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each residual from what its code stands for."""
        codes = np.empty((len(residual), len(self.cuts)), dtype=np.uint8)
        error = np.zeros(len(residual))
        for m, ((a, b), book) in enumerate(zip(self.cuts, self.books, strict=True)):
            d = squared(residual[:, a:b], book)
            codes[:, m] = d.argmin(axis=1)
            error += d.min(axis=1)
        return codes, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        return [squared(residual[:, a:b], book) for (a, b), book in zip(self.cuts, self.books, strict=True)]


NEAREST, FANOUT, SLICE = 8, 16, 256
ROW = "label string, size int, list int, key long, weight long, vector binary, code binary, error float, home boolean"


def reach_of(threshold: float) -> float:
    """The largest distance of unit vectors with a cosine of ``threshold``."""
    return math.sqrt(2 - 2 * threshold) + 1e-6


def reachable(book: Codebook, d: np.ndarray, reach: float) -> np.ndarray:
    """From squared distances to all centroids: which lists may hold something within ``reach``."""
    c = book.centroids
    m, at = min(NEAREST, len(c)), np.arange(len(d))
    near = np.argpartition(d, m - 1, axis=1)[:, :m]
    mean, middle = np.take_along_axis(d, near, axis=1).mean(axis=1), c[near].mean(axis=1)
    one = (d - d.min(axis=1)[:, None]) <= 2 * reach * np.sqrt(squared(c, c))[d.argmin(axis=1)] + 1e-9
    several = (d - mean[:, None]) <= 2 * reach * np.sqrt(squared(middle, c)) + 1e-9
    out = one & several
    out[at, d.argmin(axis=1)] = True
    return out


def _assign(shared, reach: float, kind: str):
    """Index rows (with code) and query rows (without) of each vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book: Codebook = shared.value
        names = ["label", "size", "key", "weight"]
        for b in batches:
            usual = b["size"] == book.width
            other = b[~usual]
            if len(other):
                rows = other[names].assign(list=np.int32(-1), vector=pack(other["vector"].tolist(), kind), code=None, error=np.float32(0), home=True)
                yield rows.assign(code=[b""] * len(rows))
                yield rows
            b = b[usual]
            for s in range(0, len(b), 2000):
                part = b.iloc[s : s + 2000]
                x = unit(np.stack([np.asarray(v, dtype=np.float64) for v in part["vector"]]))
                d = squared(x, book.centroids)
                home = d.argmin(axis=1)
                codes, error = book.encode(x - book.centroids[home])
                rows = part[names].assign(list=home.astype(np.int32), vector=pack(part["vector"].tolist(), kind), code=[z.tobytes() for z in codes], error=error.astype(np.float32), home=True)
                yield rows
                probes = reachable(book, d, reach) & (np.arange(d.shape[1])[None, :] <= home[:, None])
                who, lists = np.nonzero(probes)
                yield rows.iloc[who].assign(list=lists.astype(np.int32), code=None, home=lists == home[who])

    return run


def forest(hits: np.ndarray) -> Iterator[list[int]]:
    """The components of a two-sided graph: places of rows, and of columns counted on after the rows."""
    n = len(hits)
    rows_left, cols_left = hits.any(axis=1), hits.any(axis=0)
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        stack, members = [int(start)], []
        while stack:
            k = stack.pop()
            members.append(k)
            left = cols_left if k < n else rows_left
            new = np.flatnonzero((hits[k] if k < n else hits[:, k - n]) & left)
            left[new] = False
            stack += (new + n if k < n else new).tolist()
        yield members


def tree(keys: list[int]) -> Iterator[tuple[int, int]]:
    """Edges that hold the keys together with at most ``FANOUT`` + 1 at each."""
    keys = sorted(set(keys))
    for k in range(1, len(keys)):
        yield keys[(k - 1) // FANOUT], keys[k]


def _compare(shared, threshold: float, kind: str):
    """Per block: the weight of the links of each vector (a, null, n), and edges of the block's forest (a, b, null)."""
    reach = reach_of(threshold)

    def block(book: Codebook, g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        q, i = g[g["is_query"]], g[~g["is_query"]]
        if not len(q) or not len(i):
            return
        x, y = unit(unpack(q["vector"], kind)), unit(unpack(i["vector"], kind))
        at, home = int(i["list"].iloc[0]), q["home"].to_numpy().astype(bool)
        a, b, wa, wb = q["key"].to_numpy(), i["key"].to_numpy(), q["weight"].to_numpy(), i["weight"].to_numpy()
        bound = (reach + i["error"].to_numpy()) ** 2 + 1e-4
        codes = np.frombuffer(b"".join(i["code"]), dtype=np.uint8).reshape(len(i), -1) if at >= 0 else None
        total = np.zeros(len(i), dtype=np.int64)
        counts, edges = [], []
        for s in range(0, len(q), SLICE):
            xs = x[s : s + SLICE]
            # pairs of one list meet twice, and count once
            maybe = ~home[s : s + SLICE][:, None] | (a[s : s + SLICE][:, None] < b[None, :])
            if codes is not None:
                guess = np.zeros((len(xs), len(i)), dtype=np.float32)
                for m, table in enumerate(book.tables(xs - book.centroids[at])):
                    guess += np.take(table.astype(np.float32), codes[:, m], axis=1)
                maybe &= guess <= bound[None, :]
            rows, cols = np.nonzero(maybe)
            good = np.zeros(len(rows), dtype=bool)
            for k in range(0, len(rows), 200_000):
                t = slice(k, k + 200_000)
                good[t] = np.einsum("ij,ij->i", xs[rows[t]], y[cols[t]]) >= threshold
            if not good.any():
                continue
            hits = np.zeros(maybe.shape, dtype=bool)
            hits[rows[good], cols[good]] = True
            n = hits @ wb
            counts += [(int(k), None, int(v)) for k, v in zip(a[s : s + SLICE][n > 0], n[n > 0], strict=True)]
            total += wa[s : s + SLICE] @ hits
            names = np.concatenate([a[s : s + SLICE], b])
            edges += [(*e, None) for members in forest(hits) for e in tree(names[members].tolist())]
        counts += [(int(k), None, int(v)) for k, v in zip(b[total > 0], total[total > 0], strict=True)]
        if counts:
            yield pd.DataFrame(counts + edges, columns=["a", "b", "n"], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in whole_groups(batches, ["group"]):
            yield from block(shared.value, g)

    return run


def near_duplicates(
    rows: DataFrame,
    threshold: float = 0.93,
    reach: float | None = None,
    list_rows: int = 4096,
    max_lists: int = 4096,
    max_train: int = 20_000,
    subspaces: int = 16,
    words: int = 64,
    block: int = 4096,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of (vec_id, embedding, label).

    One coarse list for every ``list_rows`` vectors, ``max_lists`` at most; training reads about ``max_train`` vectors.
    ``reach`` is how far from a vector lists are probed: by default as far as a partner can be, so that none is lost; a
    smaller value probes less and may lose some.
    """
    out: DataFrame | None = None
    with cleared(rows.sparkSession, lambda: out):
        out = stable(_near(rows, threshold, reach if reach is not None else reach_of(threshold), list_rows, max_lists, max_train, subspaces, words, block))
    return out


def _near(rows: DataFrame, threshold: float, reach: float, list_rows: int, max_lists: int, max_train: int, subspaces: int, words: int, block: int) -> DataFrame:
    spark = rows.sparkSession
    base = rows.select(F.col("vec_id").cast("long"), "embedding", "label", usable().alias("ok")).withColumn("ok", F.col("ok") & F.col("label").isNotNull())
    good = base.filter("ok").select(
        "vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"),
        F.xxhash64("label", "embedding").alias("h1"), F.xxhash64("embedding", F.lit(7), "label").alias("h2"),
    )
    groups = stable(
        good.groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("vec_id").alias("id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .select("*", F.size("vector").alias("size"), F.monotonically_increasing_id().alias("key"))
    )
    n, kind = groups.count(), width_of(rows)
    sample = unit(training_sample(groups, n, max_train, "vector", "key"))
    book = Codebook.train(sample, max(1, min(max_lists, round(n / list_rows))), subspaces, words)
    shared = spark.sparkContext.broadcast(book)  # bounded by max_lists
    placed = stable(groups.select("label", "size", "key", "weight", "vector").mapInPandas(_assign(shared, reach, kind), ROW))
    index = placed.filter(F.col("code").isNotNull())
    dealt = blocked(index, placed.filter(F.col("code").isNull()).drop("code", "error"), ["label", "size", "list"], "key", block)
    found = stable(
        dealt.repartition(shuffle_partitions(spark), "group").sortWithinPartitions("group").mapInPandas(_compare(shared, threshold, kind), "a long, b long, n long")
    )
    component = connected_components(found.filter("b is not null").select("a", "b")).select(F.col("id").alias("key"), "component")
    links = found.filter("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    every = groups.select("h1", "h2", "key", "id", "weight").join(links, "key", "left").join(component, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = every.groupBy("component").agg(F.min("id").alias("component_id"))
    named = every.join(least, "component").select("h1", "h2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    done = good.select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = base.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_dedup(rows: DataFrame) -> DataFrame:
    return near_duplicates(rows)


OP1_SQL = """
with recursive good as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id
  where len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) as (
  select vec_id, vec_id from embeddings union select r.a, p.b from reach r join pairs p on r.b = p.a
), least as (select a, min(b) as m from reach group by a), n as (select a, count(*) as n from pairs group by a)
select e.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, l.m as component_id, e.vec_id = l.m as kept
from embeddings e join least l on e.vec_id = l.a left join n on n.a = e.vec_id
"""
