"""Sequential ratings. A rating is a recurrence over time: a bout needs the ratings that all earlier bouts of both
competitors left. By default all bouts share one table of ratings; a column can be named that keeps tables apart
(divisions, or anything else that no competitor crosses). Time is cut into slices that run side by side until their
starts agree (``slices``); only the search over settings streams all bouts, packed, through a task of several settings in order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringside.operators.slices import in_slices, waves
from ringside.operators.tables import written

c = F.col

START, SCALE = 1500.0, 400.0
RD0, DRIFT, Q = 350.0, 34.0, 0.0057565  # fixed values: first deviation, growth per period, ln(10) / 400
GLICKO2_SCALE, TAU, EPSILON = 173.7178, 0.3, 1e-6  # fixed values


def expected_score(a: float, b: float, scale: float = SCALE) -> float:
    return 1 / (1 + 10 ** ((b - a) / scale))


def expected_prob(a: Column, b: Column, scale: float = SCALE) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / scale))


def scale_of_w90(w90: float) -> float:
    """The scale on which a lead of ``w90`` points means a win chance of 0.9."""
    return w90 / math.log10(9)


# fixed values: factors on K by margin of victory
MARGINS: dict[str, Callable[[float], float]] = {
    "none": lambda w: 1.0,
    "linear": lambda w: max(w - 1, 1.0),
    "log": lambda w: math.log(150 * max(w - 1, 0.0) + 1),
    "sqrt": lambda w: math.sqrt(100 * max(w, 0.0)),
    "exp": lambda w: 3 ** max(w, 0.0),
}


@dataclass
class Elo:
    """State and step of Elo. Optional: a factor on K by margin of victory (none counts as 1), ``cutoff_k_scale`` on K
    where both ratings have reached ``cutoff``, and regression of all ratings to 1500 after every ``season`` bouts."""

    k: float = 32.0
    scale: float = SCALE
    margin: str = "none"
    cutoff: float | None = None
    cutoff_k_scale: float = 0.5
    season: int = 0
    regress: float = 0.0

    def __post_init__(self) -> None:
        self.rating: dict[str, float] = {}
        self.told: dict[str, int] = {}  # after how many seasons a rating was told; those since then are applied when it is read
        self.seen = 0

    def seasons(self) -> int:
        return self.seen // self.season if self.season else 0

    def now(self, fighter: str) -> float:
        r = self.rating.get(fighter, START)
        missed = self.seasons() - self.told.get(fighter, 0) if self.season else 0
        return START + (r - START) * (1 - self.regress) ** missed if missed else r

    def ratings(self) -> dict[str, float]:
        return {f: self.now(f) for f in self.rating}

    def load(self, fighter: str, values: list[float]) -> None:
        """A rating and after how many seasons it was told."""
        self.rating[fighter], self.told[fighter] = values[0], int(values[1])

    def step(self, red: str, blue: str, score: float | None, margin: float = 1.0) -> tuple[float, float, float]:
        """Ratings before the bout and the expected score of red; the update follows. score: 1, 0, 0.5 or None."""
        a, b = self.now(red), self.now(blue)
        mu = expected_score(a, b, self.scale)
        if score is not None:
            k = self.k * MARGINS[self.margin](margin if margin > 0 else 1.0)
            if self.cutoff is not None and min(a, b) >= self.cutoff:
                k *= self.cutoff_k_scale
            self.rating[red], self.rating[blue] = a + k * (score - mu), b - k * (score - mu)
            if self.season:
                self.told[red] = self.told[blue] = self.seasons()
            self.seen += 1
        return a, b, mu


def _scored(winner: np.ndarray) -> np.ndarray:
    return np.isfinite(winner) & (winner != 2)


@dataclass
class EloStep:
    """``Elo`` for many bouts at once, none of whose fighters meets twice. A state is a rating and after how many seasons it was told."""

    k: float = 32.0
    scale: float = SCALE
    margin: str = "none"
    cutoff: float | None = None
    cutoff_k_scale: float = 0.5
    season: int = 0
    regress: float = 0.0

    def now(self, state: np.ndarray, seasons: np.ndarray) -> np.ndarray:
        missed = seasons - state[:, 1]
        return np.where(missed > 0, START + (state[:, 0] - START) * (1 - self.regress) ** missed, state[:, 0]) if self.season else state[:, 0]

    def __call__(self, red: np.ndarray, blue: np.ndarray, seen: np.ndarray, winner: np.ndarray, margin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seasons = seen // self.season if self.season else np.zeros(len(seen))
        a, b = self.now(red, seasons), self.now(blue, seasons)
        mu = expected_score(a, b, self.scale)
        scored = _scored(winner)
        k = np.full(len(a), self.k)
        if margin is not None:
            sizes, at = np.unique(np.where(margin > 0, margin, 1.0), return_inverse=True)
            k = k * np.array([MARGINS[self.margin](float(w)) for w in sizes])[at]
        if self.cutoff is not None:
            k = np.where(np.minimum(a, b) >= self.cutoff, k * self.cutoff_k_scale, k)
        change = k * (np.where(scored, winner, 0.0) - mu)
        new = lambda old, r: np.where(scored[:, None], np.column_stack([r, seasons]), old)
        return np.column_stack([a, b, mu]), new(red, a + change), new(blue, b - change)


@dataclass
class Glicko:
    """Glicko-1, one bout a period, for many bouts at once. Only a red win counts for red; ``draws`` gives other results half a point."""

    draws: bool = False

    @staticmethod
    def updated(me: np.ndarray, other: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The new rating and deviation; the own deviation has grown, that of the opponent is as it was."""
        r, r2, rd2 = me[:, 0], other[:, 0], other[:, 1]
        rd = np.minimum(np.sqrt(me[:, 1] * me[:, 1] + DRIFT * DRIFT), RD0)
        g = 1 / np.sqrt(1 + 3 * Q * Q * rd2 * rd2 / math.pi**2)
        e = 1 / (1 + 10 ** (-g * (r - r2) / 400))
        d2 = 1 / (Q * Q * g * g * e * (1 - e))
        shrink = 1 / (1 / (rd * rd) + 1 / d2)
        return np.column_stack([r + Q * shrink * g * (score - e), np.sqrt(shrink)])

    def __call__(self, red: np.ndarray, blue: np.ndarray, seen: np.ndarray, winner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.where(winner == 1, 1.0, np.where(winner != 0, 0.5, 0.0) if self.draws else 0.0)
        return np.column_stack([red, blue]), self.updated(red, blue, score), self.updated(blue, red, 1 - score)


class Glicko2:
    """Glicko-2 (Glickman 2012), one bout a period, for many bouts at once; volatility by the Illinois iteration."""

    def __init__(self, tau: float = TAU) -> None:
        self.tau = tau

    def volatility(self, delta: np.ndarray, phi: np.ndarray, v: np.ndarray, sigma: np.ndarray) -> np.ndarray:
        shape = np.shape(sigma)
        delta, phi, v, a = (np.array(x, dtype=float).ravel() for x in (delta, phi, v, np.log(sigma * sigma)))

        def f(x: np.ndarray, i: np.ndarray) -> np.ndarray:
            e, d2, p2 = np.exp(x), delta[i] * delta[i], phi[i] * phi[i]
            return e * (d2 - p2 - v[i] - e) / (2 * (p2 + v[i] + e) ** 2) - (x - a[i]) / self.tau**2

        every = np.arange(len(a))
        over = delta * delta - phi * phi - v
        left, right = a.copy(), np.log(np.where(over > 0, over, 1.0))
        open_, k = every[over <= 0], 1
        while len(open_):
            right[open_] = a[open_] - k * self.tau
            open_, k = open_[f(right[open_], open_) < 0], k + 1
        fl, fr = f(left, every), f(right, every)
        i = every[np.abs(right - left) > EPSILON]
        while len(i):
            x = left[i] + (left[i] - right[i]) * fl[i] / (fr[i] - fl[i])
            fx = f(x, i)
            crossed = fx * fr[i] <= 0
            left[i], fl[i] = np.where(crossed, right[i], left[i]), np.where(crossed, fr[i], fl[i] / 2)
            right[i], fr[i] = x, fx
            i = i[np.abs(right[i] - left[i]) > EPSILON]
        return np.exp(left / 2).reshape(shape)

    def updated(self, me: tuple, other: tuple, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mu, phi, sigma = me
        g = 1 / np.sqrt(1 + 3 * other[1] * other[1] / math.pi**2)
        e = 1 / (1 + np.exp(-g * (mu - other[0])))
        v = 1 / (g * g * e * (1 - e))
        sigma = self.volatility(v * g * (score - e), phi, v, sigma)
        phi = 1 / np.sqrt(1 / (phi * phi + sigma * sigma) + 1 / v)
        return mu + phi * phi * g * (score - e), phi, sigma

    def __call__(self, red: np.ndarray, blue: np.ndarray, seen: np.ndarray, winner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        score = np.where((winner == 1) | (winner == 0), winner, 0.5)
        a, b = tuple(red.T), tuple(blue.T)
        out = [x for s in (a, b) for x in (START + GLICKO2_SCALE * s[0], GLICKO2_SCALE * s[1])]
        return np.column_stack(out), np.column_stack(self.updated(a, b, score)), np.column_stack(self.updated(b, a, 1 - score))


ELO, GLICKO = ["elo_red", "elo_blue", "mu"], ["r_red", "rd_red", "r_blue", "rd_blue"]
CORNERS = ["fighter_red", "fighter_blue"]


def _doubles(names: list[str]) -> str:
    return ", ".join(f"{n} double" for n in names)


def elo(bouts: DataFrame, part: str | None = None, k: float = 32.0, scale: float = SCALE, **slicing) -> DataFrame:
    """Elo of both corners before each bout, and red's expected score; draws and unknown results change nothing."""
    return in_slices(bouts, part, [*CORNERS, "winner"], EloStep(k=k, scale=scale), [START, 0.0], _doubles(ELO), ELO, **slicing)


def matches(bouts: DataFrame, score_red: Column, score_blue: Column) -> DataFrame:
    """Bouts with ``margin`` (of the scores) and ``outcome``: who won, or by the scores where nobody is said to have."""
    by_score = (score_red > score_blue).cast("int")
    return bouts.withColumns({"margin": F.abs(score_red - score_blue).cast("double"), "outcome": F.when(F.col("winner").isin(0, 1), F.col("winner")).otherwise(by_score)})


def margin_elo(played: DataFrame, part: str | None = None, slicing: dict | None = None, **settings) -> DataFrame:
    """Elo with a margin of victory over ``matches``; every match counts."""
    scored = F.col("outcome").isin(0, 1)
    return in_slices(played, part, [*CORNERS, "outcome", "margin"], EloStep(**settings), [START, 0.0], _doubles(ELO), ELO, scored=scored, **(slicing or {}))


def glicko(bouts: DataFrame, part: str | None = None, draws: bool = False, **slicing) -> DataFrame:
    return in_slices(bouts, part, [*CORNERS, "winner"], Glicko(draws), [START, RD0], _doubles(GLICKO), GLICKO, drift=0, **slicing)


def glicko2(bouts: DataFrame, part: str | None = None, **slicing) -> DataFrame:
    """The volatility's iteration stops at a step, so that slices settle after as many rounds as there are slices."""
    return in_slices(bouts, part, [*CORNERS, "winner"], Glicko2(), [0.0, RD0 / GLICKO2_SCALE, 0.06], _doubles(GLICKO), GLICKO, drift=0, **slicing)


def elo_and_glicko(bouts: DataFrame, part: str | None = None, k: float = 32.0, **slicing) -> DataFrame:
    """Both ratings in one pass, with red - blue differences. Glicko's rating is first in the state."""
    first, second = EloStep(k=k), Glicko()

    def step(red: np.ndarray, blue: np.ndarray, seen: np.ndarray, winner: np.ndarray) -> tuple[np.ndarray, ...]:
        e, *elos = first(red[:, 2:], blue[:, 2:], seen, winner)
        g, *glickos = second(red[:, :2], blue[:, :2], seen, winner)
        return np.column_stack([e[:, :2], g[:, [0, 2, 1, 3]]]), *[np.column_stack([x, y]) for x, y in zip(glickos, elos, strict=True)]

    names = [f"{n}_{c}" for n in ("elo", "glicko", "glicko_rd") for c in ("red", "blue")]
    done = in_slices(bouts, part, [*CORNERS, "winner"], step, [START, RD0, START, 0.0], _doubles(names), names, drift=0, **slicing)
    return done.select("*", *[(F.col(f"{n}_red") - F.col(f"{n}_blue")).alias(f"{n}_diff") for n in ("elo", "glicko", "glicko_rd")])


SETTINGS = {"base_k": "double", "mov_mode": "string", "cutoff_rating": "double", "cutoff_k_scale": "double", "w90": "double", "regress_to_mean": "double", "regress_every": "int"}


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """One row a setting: all combinations of the values given; what isn't given is 20, log, none, 1, none, 0, none."""
    usual = {"base_k": [20.0], "mov_mode": ["log"], "cutoff_rating": [None], "cutoff_k_scale": [1.0], "w90": [None], "regress_to_mean": [0.0], "regress_every": [None]}
    rows = [(i, *combination) for i, combination in enumerate(product(*(usual | values).values()))]
    return spark.createDataFrame(rows, "setting int, " + ", ".join(f"{k} {t}" for k, t in SETTINGS.items()))


def folds_of(n: int, folds: int, first_share: float, window_share: float) -> list[tuple[int, int]]:
    """(where training ends and validation starts, where it ends) of each expanding fold over n matches."""
    first, window = int(n * first_share), int(n * window_share)
    step = (n - first - window) // max(1, folds - 1)
    return [(end, min(end + window, n)) for end in (first + i * step for i in range(folds))] if first and window else []


def _packed(played: DataFrame) -> tuple[DataFrame, int]:
    """Matches in time order as rows of some thousands each: ``chunk`` orders them, the columns are numbers in binary; and how many
    fighters there are. A match takes 21 bytes."""
    pair = [c(x) for x in CORNERS]
    known = played.select(F.explode(F.array(*pair)).alias("f")).filter("f is not null").distinct()
    code, size = known.select("f", (F.row_number().over(Window.orderBy("f")) - 1).alias("code")), known.count()  # one row a competitor
    told = played.select("moment", *CORNERS, c("outcome").cast("double").alias("outcome"), "margin")
    for x in CORNERS:
        told = told.join(code.select(c("f").alias(x), c("code").alias(f"{x}_code")), x, "left").withColumn(f"{x}_code", F.coalesce(f"{x}_code", F.lit(size)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            kinds = {"red": np.int32, "blue": np.int32, "outcome": np.float32, "margin": np.float64}
            yield pd.DataFrame({"chunk": [at + k], **{x: [b[x].to_numpy(dtype=t).tobytes()] for x, t in kinds.items()}})

    tasks = max(2, int(played.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    line = told.repartitionByRange(tasks, "moment").sortWithinPartitions("moment")
    narrow = line.select(*[c(f"{x}_code").alias(x.removeprefix("fighter_")) for x in CORNERS], "outcome", "margin")
    return written(narrow.mapInPandas(pack, "chunk long, red binary, blue binary, outcome binary, margin binary"))[0], size


class ManyElos:
    """Elo under several settings at once: one column a setting, many matches a step; each as in ``Elo``."""

    def __init__(self, settings: list[dict], fighters: int) -> None:
        get = lambda x, none: np.array([none if s[x] is None else s[x] for s in settings], dtype=float)
        self.k, self.cutoff, self.cut_scale = get("base_k", 0.0), get("cutoff_rating", np.inf), get("cutoff_k_scale", 1.0)
        self.scale = np.array([scale_of_w90(s["w90"]) if s["w90"] is not None else SCALE for s in settings])
        self.season, self.keep = get("regress_every", 0.0), 1 - get("regress_to_mean", 0.0)
        self.modes = [s["mov_mode"] for s in settings]
        self.rating, self.told = np.full((fighters, len(settings)), START), np.zeros(fighters)
        self.seen = 0

    def now(self, who: np.ndarray, seen: np.ndarray) -> np.ndarray:
        r = self.rating[who]
        every = np.where(self.season > 0, self.season, np.inf)
        missed = seen[:, None] // every - self.told[who][:, None] // every
        return np.where(missed > 0, START + (r - START) * self.keep**missed, r) if (missed > 0).any() else r

    def all_now(self) -> np.ndarray:
        return self.now(np.arange(len(self.told)), np.full(len(self.told), self.seen, dtype=float))

    def expected(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 / (1 + 10 ** ((b - a) / self.scale))

    def play(self, red: np.ndarray, blue: np.ndarray, outcome: np.ndarray, margin: np.ndarray) -> None:
        scored = np.isin(outcome, (0, 1))
        seen = self.seen + np.cumsum(scored) - scored
        self.seen += int(scored.sum())
        red, blue, won, seen = red[scored], blue[scored], outcome[scored].astype(float), seen[scored].astype(float)
        if not len(red):
            return
        sizes, at = np.unique(np.where(margin[scored] > 0, margin[scored], 1.0), return_inverse=True)
        factor = np.array([[MARGINS[m](float(w)) for m in self.modes] for w in sizes]) * self.k
        for i in waves(red.tolist(), blue.tolist()):
            a, b = self.now(red[i], seen[i]), self.now(blue[i], seen[i])
            k = factor[at[i]] * np.where(np.minimum(a, b) >= self.cutoff, self.cut_scale, 1.0)
            change = k * (won[i][:, None] - self.expected(a, b))
            self.rating[red[i]] = a + change
            self.rating[blue[i]] = b - change
            self.told[red[i]] = self.told[blue[i]] = seen[i]


def grid_search(played: DataFrame, settings: DataFrame, folds: int = 5, first_share: float = 0.2, window_share: float = 0.1, together: int = 8) -> DataFrame:
    """Mean log-loss and Brier score of each Elo setting over expanding folds, best first.

    A fold is rated with the ratings as its training part left them. All folds train from the first match on, so one
    pass takes a copy of the ratings where each fold begins. A task passes the packed matches in order and rates ``together`` settings
    at once; it holds their ratings and tells sums, so that no row a match and setting is ever made.
    """
    spark = played.sparkSession
    every = [r.asDict() for r in settings.collect()]  # a fixed small grid
    packed, size = _packed(played)
    cuts = folds_of(played.count(), folds, first_share, window_share)
    jobs = [every[i : i + together] for i in range(0, len(every), together)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, table, at, frozen, sums = None, None, 0, {}, None
        for b in batches:
            for number, *columns in b[["job", "red", "blue", "outcome", "margin"]].itertuples(index=False):
                if table is None:
                    job, table, sums = number, ManyElos(jobs[number], size + 1), np.zeros((len(cuts), 3, len(jobs[number])))
                red, blue, outcome, margin = (np.frombuffer(x, dtype=t) for x, t in zip(columns, (np.int32, np.int32, np.float32, np.float64), strict=True))
                edges = sorted({at, at + len(red), *(x for cut in cuts for x in cut if at < x < at + len(red))})
                for x, y in zip(edges, edges[1:], strict=False):
                    some = slice(x - at, y - at)
                    for i, (start, end) in enumerate(cuts):
                        if x == start:
                            frozen[i] = table.all_now()
                        if start <= x < end:
                            known = np.isfinite(outcome[some])
                            won = outcome[some][known].astype(float)[:, None]
                            p = np.clip(table.expected(frozen[i][red[some][known]], frozen[i][blue[some][known]]), 1e-12, 1 - 1e-12)
                            sums[i] += [-(won * np.log(p) + (1 - won) * np.log(1 - p)).sum(axis=0), ((p - won) ** 2).sum(axis=0), np.full(p.shape[1], len(p))]
                        elif x >= end:
                            frozen.pop(i, None)
                    table.play(red[some], blue[some], outcome[some], margin[some])
                at += len(red)
        if table is not None:
            rows = [(s["setting"], i, *(sums[i, :2, j] / sums[i, 2, j])) for i in range(len(cuts)) for j, s in enumerate(jobs[job]) if sums[i, 2, j]]
            yield pd.DataFrame(rows, columns=["setting", "fold", "logloss", "brier"])

    sent = packed.withColumn("job", F.explode(F.sequence(F.lit(0), F.lit(max(0, len(jobs) - 1))))).repartitionById(max(1, len(jobs)), "job")
    scored = sent.sortWithinPartitions("chunk").mapInPandas(run, "setting int, fold int, logloss double, brier double")
    means = scored.groupBy("setting").agg(F.avg("logloss").alias("logloss"), F.avg("brier").alias("brier"))
    return means.join(F.broadcast(settings), "setting").orderBy("logloss", "setting")


def evaluation(rated: DataFrame) -> DataFrame:
    """Accuracy, calibration (sum of expected over actual wins) and log-loss of (mu, winner)."""
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("mu")))
    right = ((F.col("mu") > 0.5).cast("int") == F.col("winner")).cast("double")
    return rated.filter("winner in (0, 1)").agg(
        F.avg(right).alias("accuracy"), (F.sum("mu") / F.sum("winner")).alias("calibration"),
        F.avg(-(F.col("winner") * F.ln(p) + (1 - F.col("winner")) * F.ln(1 - p))).alias("logloss"), F.count("*").alias("n"),
    )
