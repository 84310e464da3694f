"""What the two vector operators share: valid rows, k-means, blocks of cells, whole groups within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, without null or non-finite components, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def training_sample(rows: DataFrame, n: int, limit: int, vector: str, key: str) -> np.ndarray:
    """About ``limit`` vectors at most, drawn by a hash of the key; padded or cut to the longest common length."""
    share = min(1.0, limit / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64(key, F.lit(23)), F.lit(1 << 30)) < int(share * (1 << 30))).select(key, vector)
    got = [np.asarray(r[1], dtype=np.float64) for r in sorted(drawn.collect(), key=lambda r: (r[0] is None, r[0]))]
    if not got:
        return np.zeros((0, 1))
    sizes = np.bincount([len(v) for v in got])
    return fit_length(got, int(sizes.argmax()))


def width_of(rows: DataFrame, vector: str = "embedding") -> str:
    """How components are sent between tasks: as they are stored, four bytes or eight."""
    return "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def pack(vectors: list[np.ndarray], kind: str) -> list[bytes]:
    return [np.asarray(v, dtype=kind).tobytes() for v in vectors]


def unpack(data: pd.Series, kind: str) -> np.ndarray:
    """Rows of one length, in double precision."""
    return np.frombuffer(b"".join(data), dtype=kind).reshape(len(data), -1).astype(np.float64)


def fit_length(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Rows of one width: shorter vectors padded with zeros, longer ones cut."""
    if all(len(v) == width for v in vectors):
        return np.stack(vectors).astype(np.float64) if len(vectors) else np.zeros((0, width))
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        out[k, : min(width, len(v))] = v[:width]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def k_means(x: np.ndarray, k: int, rounds: int = 10, seed: int = 0, balance: bool = False) -> np.ndarray:
    """Centroids. With balance, each round moves the emptiest centroids into clusters of over twice the mean size."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[rng.permutation(len(x))[:k]].copy()
    for turn in range(rounds):
        near = np.concatenate([squared(x[a : a + 8192], c).argmin(axis=1) for a in range(0, len(x), 8192)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        if turn < rounds - 2:
            big = [j for j in np.argsort(-size) if size[j] > 2 * len(x) / k] if balance else []
            free = [j for j in np.argsort(size) if size[j] < (len(x) / k / 4 if balance else 1)]
            for j, to in zip(free, big or list(np.argsort(-size)), strict=False):
                inside = np.flatnonzero(near == to)
                if j != to and len(inside) > 1:
                    c[j] = x[rng.choice(inside)]
    return c


def blocked(index: DataFrame, queries: DataFrame, cell: list[str], key: str, block: int) -> DataFrame:
    """Rows of both sides, dealt so that every pair of a cell meets in one group (cell, index block, query block) of at
    most about ``block`` rows of either side. Column ``is_query`` tells the sides apart."""
    sizes = (
        index.groupBy(*cell).agg(F.count("*").alias("n_index"))
        .join(queries.groupBy(*cell).agg(F.count("*").alias("n_query")), cell)
        .select(*cell, F.ceil(F.col("n_index") / block).cast("int").alias("ni"), F.ceil(F.col("n_query") / block).cast("int").alias("nq"))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    a = index.withColumn("is_query", F.lit(False)).join(sizes, cell).withColumn("ib", own("ni")).withColumn("qb", every("nq"))
    b = queries.withColumn("is_query", F.lit(True)).join(sizes, cell).withColumn("qb", own("nq")).withColumn("ib", every("ni"))
    group = F.xxhash64(*cell, "ib", "qb").alias("group")
    return a.unionByName(b, allowMissingColumns=True).select(group, *[c for c in {**dict.fromkeys(a.columns), **dict.fromkeys(b.columns)} if c not in ("ni", "nq", "ib", "qb")])


def whole_groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches that are sorted by the columns ``by``."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        changed = np.zeros(len(b) - 1, dtype=bool)
        for c in by:
            v = b[c].to_numpy()
            changed |= v[1:] != v[:-1]
        cuts = np.flatnonzero(changed) + 1
        for x, y in zip([0, *cuts], [*cuts, len(b)], strict=True):
            piece = b.iloc[x:y]
            if rest and any(rest[0][c].iloc[0] != piece[c].iloc[0] for c in by):
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(piece)
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]
