"""A classifier of two towers with shared weights: the same small network rates both corners, the difference of their ratings decides.

Training is data-parallel: a task sums loss and gradient over its batches, the sums of all tasks are added by place, and the
driver moves the weights (some hundred numbers) by limited-memory BFGS. One scan an evaluation; rows never leave
their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.penalised import sums_over

c = F.col


class Towers:
    """rating(x) = w2 . tanh(W1 x + b1) + v . x; logit = rating(red) - rating(blue) + bias. Weights are one flat vector."""

    def __init__(self, width: int, hidden: int = 8) -> None:
        self.width, self.hidden = width, hidden
        self.size = hidden * width + 2 * hidden + width + 1

    def start(self, seed: int = 3) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.normal(scale=self.width**-0.5, size=self.hidden * self.width), np.zeros(self.hidden), rng.normal(scale=0.1, size=self.hidden), np.zeros(self.width + 1)])

    def parts(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
        k, d = self.hidden, self.width
        a = np.split(w, np.cumsum([k * d, k, k, d]))
        return a[0].reshape(k, d), a[1], a[2], a[3], float(a[4][0])

    def logit(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """x: rows of both corners' features, red first."""
        w1, b1, w2, v, bias = self.parts(w)
        red, blue = x[:, : self.width], x[:, self.width :]
        rate = lambda z: np.tanh(z @ w1.T + b1) @ w2 + z @ v
        return rate(red) - rate(blue) + bias

    def loss_and_gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums over the rows: loss, gradient, rows."""
        w1, b1, w2, _, _ = self.parts(w)
        z = self.logit(w, x)
        off = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        g1, gb, g2, gv = np.zeros_like(w1), np.zeros_like(b1), np.zeros_like(w2), np.zeros(self.width)
        for sign, own in ((1, x[:, : self.width]), (-1, x[:, self.width :])):
            h = np.tanh(own @ w1.T + b1)
            e = sign * off
            back = e[:, None] * w2 * (1 - h * h)
            g1, gb, g2, gv = g1 + back.T @ own, gb + back.sum(axis=0), g2 + e @ h, gv + e @ own
        loss = np.logaddexp(0, z).sum() - (y * z).sum()
        return np.concatenate([[loss], g1.ravel(), gb, g2, gv, [off.sum(), len(y)]])


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, memory: int = 8) -> tuple[np.ndarray, float]:
    """Limited-memory BFGS with backtracking."""
    f, g = value(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            used.append(a)
            q = q - a * y
        q = q * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, float(np.abs(g).sum())))
        for (s, y), a in zip(past, reversed(used), strict=True):
            q = q + s * (a - (y @ q) / (y @ s))
        size, slope = 1.0, float(g @ q)
        while size > 1e-4:
            x = w - size * q
            fx, gx = value(x)
            if fx <= f - 1e-4 * size * slope:
                break
            size /= 4
        else:
            break
        if (gx - g) @ (x - w) > 1e-12:
            past = [*past, (x - w, gx - g)][-memory:]
        done = f - fx < 1e-7 * max(1.0, abs(f))
        w, f, g = x, fx, gx
        if done:
            break
    return w, f


def fit_towers(rows: DataFrame, width: int, hidden: int = 8, ridge: float = 1e-3, steps: int = 30) -> tuple[Towers, np.ndarray]:
    """The network fitted to rows (x: both corners' features, y 0 or 1)."""
    net = Towers(width, hidden)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        got = sums_over(rows, net.size + 2, lambda x, y, _: net.loss_and_gradient(w, x, y))
        n = max(got[-1], 1.0)
        return got[0] / n + ridge / 2 * float(w @ w), got[1:-1] / n + ridge * w

    return net, minimise(value, net.start(), steps)[0]


def rated(rows: DataFrame, net: Towers, w: np.ndarray) -> DataFrame:
    """With p, the chance of the red corner."""

    @F.pandas_udf("double")
    def chance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(1 / (1 + np.exp(-np.clip(net.logit(w, np.stack(x)), -35, 35))) if len(x) else [], dtype=float)

    return rows.withColumn("p", chance("x"))
