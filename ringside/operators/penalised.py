"""Many penalised logistic models over one frame at once: regularisation paths, and searches over settings and folds.

A Newton step of a model needs a weighted matrix of products of features and a gradient, sums over rows. One scan makes these sums for
all models side by side (a product of two matrices for each batch of rows); then coordinate descent solves each model's penalised
quadratic on the driver, where a model is a handful of numbers. So a path of 100 strengths, or 10 settings on 15 folds,
takes as many scans as one model does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


@dataclass(frozen=True)
class Setting:
    """Strengths of both penalties, and the fold that is held out (-1: none)."""

    l1: float
    l2: float
    fold: int = -1


def sums_over(rows: DataFrame, size: int, batch_sums) -> np.ndarray:
    """``size`` sums over all rows: of each task first, then of all tasks by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                x, y, fold = (b.column(n) for n in ("x", "y", "fold"))
                total += batch_sums(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), y.to_numpy(zero_copy_only=False).astype(float), fold.to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    parts = rows.select("x", "y", "fold").mapInArrow(run, "sums array<double>")
    summed = parts.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in summed:
        out[r["at"]] = r["v"]
    return out


def _descend(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l1: np.ndarray, l2: np.ndarray, sweeps: int = 500) -> np.ndarray:
    """Coordinate descent on all models' quadratics (models x coefficients, the last one the intercept, without penalty)."""
    b, start = beta.copy(), beta
    d = b.shape[1]
    slope = gradient.copy()
    for _ in range(sweeps):
        moved = 0.0
        for j in range(d):
            h = np.maximum(hessian[:, j, j], 1e-12)
            a = h * b[:, j] - slope[:, j]
            new = a / h if j == d - 1 else np.sign(a) * np.maximum(np.abs(a) - l1, 0) / (h + l2)
            step = new - b[:, j]
            b[:, j] = new
            slope += hessian[:, :, j] * step[:, None]
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-9:
            break
    return np.where(np.isfinite(b), b, start)


def fit_many(rows: DataFrame, settings: list[Setting], width: int, scans: int = 20, tolerance: float = 1e-6) -> tuple[np.ndarray, int]:
    """Coefficients of every setting (models x width + 1, the last one the intercept) over rows (x array<double>, y 0 or 1,
    fold int), and the number of scans. Objective: mean log-loss + l1 |w| + l2 |w|^2 / 2."""
    m, d = len(settings), width + 1
    held = np.array([s.fold for s in settings])
    l1, l2 = (np.array([getattr(s, x) for s in settings]) for x in ("l1", "l2"))
    upper = np.triu_indices(d)
    beta, taken = np.zeros((m, d)), 0
    active = np.ones(m, bool)
    while taken < scans and active.any():
        some, now = np.flatnonzero(active), beta[active]
        folds, k = held[active], int(active.sum())

        def batch_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, now=now, folds=folds) -> np.ndarray:
            x = np.column_stack([x, np.ones(len(x))])
            inside = fold[:, None] != folds[None, :]
            p = 1 / (1 + np.exp(-np.clip(x @ now.T, -35, 35)))
            products = x[:, upper[0]] * x[:, upper[1]]
            return np.concatenate([((p * (1 - p) * inside).T @ products).ravel(), (((p - y[:, None]) * inside).T @ x).ravel(), inside.sum(axis=0)])

        u = len(upper[0])
        got = sums_over(rows, k * (u + d + 1), batch_sums)
        n = np.maximum(got[k * (u + d) :], 1)
        hessian = np.zeros((k, d, d))
        hessian[:, upper[0], upper[1]] = got[: k * u].reshape(k, u) / n[:, None]
        hessian[:, upper[1], upper[0]] = hessian[:, upper[0], upper[1]]
        gradient = got[k * u : k * (u + d)].reshape(k, d) / n[:, None]
        new = _descend(now, gradient, hessian, l1[some], l2[some])
        beta[some] = new
        active[some] = np.abs(new - now).max(axis=1) > tolerance
        taken += 1
    return beta, taken


def macro_f1(rows: DataFrame, settings: list[Setting], beta: np.ndarray) -> np.ndarray:
    """Mean F1 of both classes of every model on its held-out fold, in one scan."""
    held = np.array([s.fold for s in settings])

    def batch_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        said = np.column_stack([x, np.ones(len(x))]) @ beta.T > 0
        own, true = fold[:, None] == held[None, :], y[:, None] == 1
        return np.concatenate([(own & said & true).sum(axis=0), (own & said & ~true).sum(axis=0), (own & ~said & true).sum(axis=0), (own & ~said & ~true).sum(axis=0)]).astype(float)

    tp, fp, fn, tn = sums_over(rows, 4 * len(settings), batch_sums).reshape(4, -1)
    f1 = lambda hit, a, b: np.divide(2 * hit, 2 * hit + a + b, out=np.zeros_like(hit), where=hit + a + b > 0)
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def stratified_folds(rows: DataFrame, folds: int, key: str = "bout_id", label: str = "y", seed: int = 5) -> DataFrame:
    """With ``fold``: each class is dealt to folds whose sizes differ by one at most, in hashed order. Places come from counts of
    hash buckets, so that no task orders a whole class."""
    h = F.xxhash64(key, F.lit(seed))
    dealt = rows.withColumns({"_h": h, "_bucket": F.shiftrightunsigned(h, 54)})
    line = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy(label, "_bucket").agg(F.count("*").alias("_n")).select(label, "_bucket", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_h", key))
    out = dealt.join(F.broadcast(before), [label, "_bucket"])  # at most 1,024 rows a class
    return out.select(*rows.columns, ((c("_before") + within - 1) % folds).cast("int").alias("fold"))


def _kernel_log(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Log density of a Parzen estimate on the unit square with a flat share."""
    if not len(points):
        return np.zeros(len(x))
    width = max(0.05, 0.5 * len(points) ** -0.25)
    d = ((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    return np.log(0.1 + 0.9 * np.exp(-d / (2 * width**2)).mean(axis=1) / (2 * np.pi * width**2))


def propose(tried: np.ndarray, scores: np.ndarray, n: int, rng: np.random.Generator, good_share: float = 0.25, pool: int = 200) -> np.ndarray:
    """n points of the unit square: at first at random, then those of a pool drawn near good points for which good ones are
    much denser than the others. Each one proposed counts as one of the others for the next."""
    if len(tried) < n:
        return rng.random((n, 2))
    order = np.argsort(-scores, kind="stable")
    good, rest = tried[order[: max(2, int(good_share * len(tried)))]], tried[order[max(2, int(good_share * len(tried))) :]]
    out = []
    for _ in range(n):
        near = np.clip(good[rng.integers(len(good), size=pool)] + rng.normal(scale=0.12, size=(pool, 2)), 0, 1)
        every = np.vstack([near, rng.random((pool // 4, 2))])
        best = every[np.argmax(_kernel_log(every, good) - _kernel_log(every, rest))]
        out.append(best)
        rest = np.vstack([rest, best])
    return np.array(out)


LOW, HIGH = -4.0, 0.0  # exponents of the strength


def parzen_search(rows: DataFrame, width: int, trials: int = 50, folds: int = 15, batch: int = 10, seed: int = 11) -> list[tuple[int, float, float, float]]:
    """(trial, reg, elastic, macro F1 over the folds) of ``trials`` settings, proposed ``batch`` at a time."""
    rng = np.random.default_rng(seed)
    tried, scores, out = np.zeros((0, 2)), np.zeros(0), []
    while len(out) < trials:
        points = propose(tried, scores, min(batch, trials - len(out)), rng)
        regs = 10 ** (LOW + (HIGH - LOW) * points[:, 0])
        settings = [Setting(float(r * e), float(r * (1 - e)), f) for r, e in zip(regs, points[:, 1], strict=True) for f in range(folds)]
        beta, _ = fit_many(rows, settings, width, tolerance=1e-4)
        got = macro_f1(rows, settings, beta).reshape(len(points), folds).mean(axis=1)
        out += [(len(out) + k, float(r), float(e), float(s)) for k, (r, e, s) in enumerate(zip(regs, points[:, 1], got, strict=True))]
        tried, scores = np.vstack([tried, points]), np.concatenate([scores, got])
    return out
