"""Stakes on many events at once that maximise expected log wealth, with several exclusive outcomes an event.

Wealth is 1 less all stakes plus the winnings of independent events, so its distribution is a convolution of theirs. In place of a
sum over all joint outcomes, the logarithm is written as an integral of exponentials (log w is the integral of
(exp(-t) - exp(-t w)) / t): under an exponential, a convolution is a product over events. With t on a logarithmic grid
the trapezoid rule is exact to rounding, for two events or two thousand, and so are gradient and curvature. Newton
steps with barriers for the bounds follow; the curvature is one small block an event and a term of the grid's rank, so
a step costs events times the square of the grid.
"""

from __future__ import annotations

import numpy as np

STEP, LOWEST, LEAST_WEALTH = 0.4, -30.0, 1e-7
GRID = np.exp(np.arange(LOWEST, np.log(750 / LEAST_WEALTH), STEP))
NOISE = 1e-13  # rounding of a value


def _paid(p: np.ndarray, odds: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each grid point: chances times exponentials (grid x events x outcomes), their sums by event, and the product."""
    nothing = 1 - p.sum(axis=1)
    nothing = np.where(nothing > 1e-12, nothing, 0.0)
    wins = odds * f
    surely = np.where(nothing > 0, 0.0, wins.min(axis=1))  # what an event pays at least; taken out so that nothing underflows
    paid = p * np.exp(-GRID[:, None, None] * (wins - surely[:, None]))
    each = nothing + paid.sum(axis=2)
    return paid, each, np.exp(np.log(each).sum(axis=1) - GRID * (1 - f.sum() + surely.sum()))


def expected_log(p: np.ndarray, odds: np.ndarray, f: np.ndarray) -> float:
    """Expected log wealth of stakes f (events x outcomes) under chances p (what is missing to 1 pays nothing) and decimal odds."""
    return STEP * float((np.exp(-GRID) - _paid(p, odds, f)[2]).sum())


def log_growth(p: np.ndarray, odds: np.ndarray, f: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expected log wealth, its gradient, and its curvature with the sign turned: blocks (an event's outcomes with each
    other) and the rows of a factor (blocks + factor' factor)."""
    r, m = p.shape
    paid, each, joint = _paid(p, odds, f)
    value = STEP * float((np.exp(-GRID) - joint).sum())
    psi = (paid * odds / each[:, :, None]).reshape(len(GRID), r * m)
    once, twice = STEP * GRID * joint, STEP * GRID**2 * joint
    gradient = (once @ (psi - 1)).reshape(r, m)
    by_event = psi.reshape(len(GRID), r, m)
    blocks = -np.einsum("t,trj,trk->rjk", twice, by_event, by_event)
    blocks[:, range(m), range(m)] += np.einsum("t,trj->rj", twice, by_event) * odds
    return value, gradient, blocks, np.sqrt(twice)[:, None] * (psi - 1)


def _newton_step(blocks: np.ndarray, factor: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Solve (blocks + factor' factor) x = g in the smaller of the two spaces."""
    r, m, _ = blocks.shape
    if r * m <= len(factor):
        whole = factor.T @ factor
        for j in range(m):
            for k in range(m):
                whole[np.arange(r) * m + j, np.arange(r) * m + k] += blocks[:, j, k]
        return np.linalg.solve(whole, g.ravel()).reshape(r, m)
    inverse = np.linalg.inv(blocks)
    apply = lambda x: np.einsum("rjk,rkn->rjn", inverse, x.reshape(r, m, -1)).reshape(r * m, -1)
    spread = apply(factor.T)
    inner = np.eye(len(factor)) + factor @ spread
    plain = apply(g.reshape(-1, 1))
    return (plain - spread @ np.linalg.solve(inner, factor @ plain)).reshape(r, m)


def best_stakes(p: np.ndarray, odds: np.ndarray, cap: float = 0.15, least: float = 1e-6, first: int = 64) -> np.ndarray:
    """Stakes (events x outcomes) in [0, cap] that sum to 1 at most and maximise expected log wealth. Stakes below
    ``least`` are 0. The same input gives the same stakes.

    A bet on an event without stakes is independent of wealth w, so a first dollar on it gains (p * odds - 1) * E[1 / w]. Events are
    therefore taken by their best p * odds: once the stakes on the ``first`` ones are the best ones and the next event would not
    gain more than what a dollar of the budget is worth, neither it nor any after it has a stake in the optimum, and
    the stakes are the whole day's. Otherwise the number is doubled."""
    p, odds = np.asarray(p, float), np.asarray(odds, float)
    if not p.size:
        return np.zeros(p.shape)
    worth = (p * odds).max(axis=1)
    order = np.argsort(-worth, kind="stable")
    out, k = np.zeros(p.shape), first
    while True:
        some = order[:k]
        f = _interior(p[some], odds[some], cap)
        if k >= len(order):
            break
        staked = f > 100 * least
        dollar = max(0.0, float(log_growth(p[some], odds[some], f)[1][staked].min())) if staked.any() else 0.0
        if (worth[order[k]] - 1) * float((STEP * GRID * _paid(p[some], odds[some], f)[2]).sum()) <= dollar:
            break
        k *= 2
    out[some] = np.where(f < least, 0.0, f)
    return out


def _interior(p: np.ndarray, odds: np.ndarray, cap: float) -> np.ndarray:
    """The best stakes on these events, before those near 0 are dropped."""
    n, m = p.size, p.shape[1]
    f = np.full(p.shape, min(cap / 2, 0.5 / (n + 1)))
    barrier = lambda x: np.log(x).sum() + np.log(cap - x).sum() + np.log(1 - x.sum())
    mu = 1e-3
    while mu > 1e-13:
        for _ in range(25):
            left = 1 - f.sum()
            value, gradient, blocks, factor = log_growth(p, odds, f)
            g = gradient + mu * (1 / f - 1 / (cap - f) - 1 / left)
            blocks[:, range(m), range(m)] += mu * (1 / f**2 + 1 / (cap - f) ** 2)
            step = _newton_step(blocks, np.vstack([factor, np.full((1, n), np.sqrt(mu) / left)]), g)
            gain, total = float((g * step).sum()), float(step.sum())
            with np.errstate(divide="ignore"):
                room = np.where(step < 0, -f / step, np.where(step > 0, (cap - f) / step, np.inf)).min()
            size = min(1.0, 0.95 * room, 0.95 * max(left - LEAST_WEALTH, 0) / total if total > 0 else np.inf)
            now = value + mu * barrier(f)
            while size > 1e-9 and expected_log(p, odds, f + size * step) + mu * barrier(f + size * step) < now - NOISE:
                size /= 4
            if size <= 1e-9:
                break
            f = f + size * step
            if gain < 0.01 * mu:
                break
        mu /= 20
    return f
