"""Staking policies over time. Stakes don't depend on the bankroll, so bets are priced as sets; only a scalar fold over
days (one row a day) runs in order."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions import staking as s
from ringside.operators.appearances import count_prior
from ringside.operators.market import choices, decimals, devig
from ringside.operators.stakes import best_stakes

c = F.col


def flat_bets(bouts: DataFrame, wager: float = 100.0) -> DataFrame:
    """Each pick at its opening line: profit, gross return, expected winnings, and whether the line is an underdog's."""
    won = c("correct") == 1
    return choices(bouts).select(
        "bout_id", "dt", "correct", (c("choice_open") > 0).cast("int").alias("is_dog"), s.flat_profit(c("choice_open"), won, wager).alias("profit"),
        s.gross(c("choice_open"), won, wager).alias("gross"), s.expected_winnings(c("choice_prob"), c("choice_open"), wager).alias("expected"),
    )


def profit_by_day(bouts: DataFrame) -> DataFrame:
    """Profit a day and its running sum; the window sorts one row a day."""
    d = flat_bets(bouts).groupBy("dt").agg(F.sum("profit").alias("profit"), F.count("*").alias("n"))
    return d.withColumn("cumulative", F.sum("profit").over(Window.orderBy("dt")))


def milestones(bouts: DataFrame, marks: tuple[float, ...] = (100.0, 1000.0, 5000.0)) -> DataFrame:
    """The first day (counted from 1) on which the running profit is at least each mark."""
    d = profit_by_day(bouts).withColumn("idx", F.row_number().over(Window.orderBy("dt")))
    one = d.agg(*[F.min(F.when(c("cumulative") >= m, c("idx"))).alias(str(int(m))) for m in marks])
    return one.unpivot([], one.columns, "mark", "first_day")


def favourites_and_dogs(bouts: DataFrame) -> DataFrame:
    return flat_bets(bouts).groupBy("is_dog", "correct").agg(F.count("*").alias("n"), F.sum("profit").alias("profit"), F.sum("gross").alias("gross"))


def winning_days(bouts: DataFrame) -> DataFrame:
    return profit_by_day(bouts).agg(F.avg((c("profit") > 0).cast("int")).alias("share"), F.count("*").alias("days"))


def kelly_bets(bouts: DataFrame) -> DataFrame:
    """Kelly fraction at the opening line, and the same shared among the positive bets of a day."""
    f = s.kelly_criterion(c("choice_prob"), c("choice_open"))
    return (
        choices(bouts).withColumn("kelly", f)
        .withColumn("positive", F.count_if(c("kelly") > 0).over(Window.partitionBy("dt")))
        .withColumn("stake", F.when(c("kelly") > 0, c("kelly") / F.greatest("positive", F.lit(1))).otherwise(0.0))
    )


def day_returns(bets: DataFrame, stake: str = "stake", net: str = "net_open") -> DataFrame:
    return bets.groupBy("dt").agg(F.sum(c(stake) * c(net)).alias("ret"), F.count_if(c(stake) > 0).alias("n"))


def bankroll(days: DataFrame, by: tuple[str, ...] = (), start: float = 1000.0, floor: float | None = None, reset: float | None = None) -> DataFrame:
    """Bankroll after each day of (dt, ret): all bets of a day use the bankroll it opened with. A bankroll at or below
    ``floor`` becomes ``reset``. One row a day passes one task in order for each ``by``, which may run side by side."""
    again = float(reset if reset is not None else start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, money = object(), start
        for b in batches:
            out = []
            for key, ret in zip(zip(*[b[k] for k in by], strict=True) if by else repeat(()), b["ret"], strict=False):
                if key != now:
                    now, money = key, start
                money *= 1 + ret
                if floor is not None and money <= floor:
                    money = again
                out.append(money)
            yield b[[*by, "dt"]].assign(bankroll=out)

    narrow = days.select(*by, "dt", c("ret").cast("double").alias("ret"))
    dealt = narrow.repartition(*by) if by else narrow.repartition(1)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.select(*by, "dt").schema)
    return dealt.sortWithinPartitions(*by, "dt").mapInPandas(run, f"{kinds}, bankroll double")


def compounded(days: DataFrame, start: float = 1000.0) -> DataFrame:
    """The same without a floor, as a window product (returns above -1)."""
    return days.select("dt", (start * F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("dt")))).alias("bankroll"))


def drawdown_scaled(bouts: DataFrame, cap: float = 0.2) -> DataFrame:
    """Per bet: Kelly fraction, its log-return deviation and drawdown over the day's bets, and the scale under the cap."""
    p, o = c("choice_prob"), c("choice_dec_close1")
    d = choices(bouts).withColumn("f", F.least(s.kelly_fraction(p, o), F.lit(0.99))).withColumn("bets", F.greatest(F.count_if(c("f") > 0).over(Window.partitionBy("dt")), F.lit(2)))
    k = F.when(c("f") > 0, s.drawdown_scale(p, o, c("f"), c("bets"), cap)).otherwise(0.0)
    sd = s.log_return_sd(p, o, c("f"))
    return d.select("bout_id", "dt", "f", "bets", sd.alias("sd"), s.expected_max_drawdown(sd, c("bets")).alias("drawdown"), k.alias("scale"), (k * c("f")).alias("f_scaled"), "net_close1")


def portfolio_scaled(bouts: DataFrame, cap: float = 0.2) -> DataFrame:
    """Per day: deviation of all bets together, expected gain, Sharpe ratio, and one scale for all stakes of the day."""
    p, o = c("choice_prob"), c("choice_dec_close1")
    d = choices(bouts).withColumn("f", F.least(s.kelly_fraction(p, o), F.lit(0.99))).filter("f > 0")
    day = d.groupBy("dt").agg(
        F.count("*").alias("n"), F.sqrt(F.sum(F.pow(c("f") * s.log_return_sd(p, o, c("f")), 2))).alias("sd"), F.sum(c("f") * s.expected_value(p, o) * c("f")).alias("mu")
    )
    k = F.least(F.lit(1.0), F.try_divide(F.lit(cap), c("sd") * F.sqrt(2 * F.ln(F.greatest("n", F.lit(2))))))
    return day.select("dt", "n", "sd", "mu", F.try_divide("mu", "sd").alias("sharpe"), F.coalesce(k, F.lit(1.0)).alias("scale"))


HORIZON = 1000  # bets over which a drawdown is expected


def kelly_picks(bouts: DataFrame, other_side: bool = False, history: bool = False, line: str = "close1") -> DataFrame:
    """Each pick with its probability p, fair and real odds, EV at the real odds, edge at the fair ones, and whether it won.

    other_side: a pick without value changes to the other corner if that has some at its fair odds. history: the edge
    counts how often earlier picks of the same fighter were right.
    """
    d = devig(decimals(bouts.filter("winner in (0, 1)")), line, "power")
    first = (c("p_red") > 0.5).cast("int")
    of = lambda side, n: F.when(side == 1, c(n.format("red"))).otherwise(c(n.format("blue")))
    real, fair = f"dec_{line}_{{}}", f"fair_odds_{{}}_{line}"
    p = F.when(first == 1, c("p_red")).otherwise(1 - c("p_red"))
    turned = (s.expected_value(p, of(first, real)) <= 0) & (s.expected_value(1 - p, of(1 - first, fair)) > 0) if other_side else F.lit(False)
    side = F.when(turned, 1 - first).otherwise(first)
    ev = F.when(turned, s.expected_value(1 - p, of(1 - first, fair))).otherwise(s.expected_value(p, of(first, real)))
    out = d.select(
        "bout_id", "dt", side.alias("side"), of(side, "fighter_{}").alias("fighter"), F.when(turned, 1 - p).otherwise(p).alias("p"), of(side, fair).alias("fair"), of(side, real).alias("real"),
        ev.alias("ev"), (side == c("winner")).alias("won"),
    )
    if not history:
        return out.withColumn("edge", s.kelly_edge(c("p"), c("fair")))
    return out.withColumn("edge", s.bayesian_edge(c("p"), c("fair"), count_prior(c("won")), count_prior(~c("won"))))


def kelly_stakes(picks: DataFrame, mode: str = "per_bet", cap: float = 0.2) -> DataFrame:
    """Stakes as shares of the bankroll: the edge where there is value, scaled bet by bet or by one factor a day so that
    the drawdown expected over HORIZON bets keeps to the cap, and divided by the day's bets, which share the bankroll."""
    day = Window.partitionBy("dt")
    f = F.when((c("edge") < 0) | (c("ev") < 0), 0.0).otherwise(F.least("edge", F.lit(0.99)))
    d = picks.withColumn("f", f).withColumn("bets", F.greatest(F.count_if(c("f") > 0).over(day), F.lit(1)))
    if mode == "per_bet":
        k = F.when(c("f") > 0, s.drawdown_scale(c("p"), c("fair"), c("f"), F.lit(HORIZON), cap)).otherwise(0.0)
    else:
        sd = F.sqrt(F.sum(F.pow(c("f") * F.coalesce(s.log_return_sd(c("p"), c("fair"), c("f")), F.lit(0.0)), 2)).over(day))
        k = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(cap), sd * math.sqrt(2 * math.log(HORIZON)))), F.lit(1.0))
    return d.withColumn("stake", k * c("f") / c("bets")).withColumn("net", F.when(c("won"), c("real") - 1).otherwise(F.lit(-1.0)))


def simulate_kelly(
    bouts: DataFrame, mode: str = "per_bet", cap: float = 0.2, start: float = 1000.0, floor: float = 100.0, reset: float = 1000.0, other_side: bool = False, history: bool = False, parlay: bool = False
) -> DataFrame:
    """The back-test: picks, scaled stakes, the two likeliest parlays of a day at their Kelly fraction if asked for, then
    the fold over days with floor and reset."""
    bets = kelly_stakes(kelly_picks(bouts, other_side, history), mode, cap)
    days = day_returns(bets, "stake", "net").select("dt", "ret")
    if parlay:
        f = s.kelly_fraction(c("p"), c("o"))
        legs = bets.select("dt", "bout_id", "p", c("real").alias("o"), "won")
        extra = best_parlays(legs, 3, 2).groupBy("dt").agg(F.sum(f * F.when(c("won"), c("o") - 1).otherwise(-1.0)).alias("more"))
        days = days.join(extra, "dt", "left").select("dt", (c("ret") + F.coalesce("more", F.lit(0.0))).alias("ret"))
    return bankroll(days, start=start, floor=floor, reset=reset)


def best_parlays(legs: DataFrame, max_legs: int, top: int) -> DataFrame:
    """For each day of (dt, bout_id, p, o, won) the ``top`` most probable combinations of 2 to ``max_legs`` picks.

    A combination among the best ``top`` only has legs among the day's best ``top + legs - 1``, so few rows are paired.
    """
    order = Window.partitionBy("dt").orderBy(c("p").desc(), "bout_id")
    leg = legs.withColumn("i", F.row_number().over(order)).filter(c("i") <= top + max_legs - 1).select("dt", "i", "p", "o", "won")
    now = leg.select("dt", c("i").alias("last"), c("i").cast("string").alias("legs"), "p", "o", "won")
    every = []
    for _ in range(max_legs - 1):
        add = leg.select("dt", "i", c("p").alias("p2"), c("o").alias("o2"), c("won").alias("won2"))
        now = now.join(add, "dt").filter(c("i") > c("last")).select(
            "dt", c("i").alias("last"), F.concat_ws("-", "legs", "i").alias("legs"), (c("p") * c("p2")).alias("p"), (c("o") * c("o2")).alias("o"), (c("won") & c("won2")).alias("won")
        )
        every.append(now)
    best = F.row_number().over(Window.partitionBy("dt").orderBy(c("p").desc(), "legs"))
    return reduce(DataFrame.unionByName, every).withColumn("rank", best).filter(c("rank") <= top).select("dt", "rank", "legs", "p", "o", "won")


def parlays(bouts: DataFrame, max_legs: int = 3, top: int = 5) -> DataFrame:
    """Probability, odds and EV of the likeliest combinations of each day's picks."""
    legs = choices(bouts).select("dt", "bout_id", c("choice_prob").alias("p"), c("choice_dec_close1").alias("o"), (c("correct") == 1).alias("won"))
    return best_parlays(legs, max_legs, top).select("dt", "rank", "legs", "p", "o", (c("p") * c("o") - 1).alias("ev"))


def monte_carlo_units(bouts: DataFrame, sims: int = 100) -> DataFrame:
    """Flat-stake paths: in each simulation the red corner wins with its probability. Final units, and per simulation."""
    p = F.when(c("pred_winner") == 1, c("choice_prob")).otherwise(1 - c("choice_prob"))
    d = choices(bouts).select("bout_id", (c("pred_winner") == 1).alias("on_red"), (c("choice_dec_close1") - 1).alias("net"), s.limit(p).alias("limit"))
    runs = d.select("*", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    hit = (s.draw(c("sim"), c("bout_id")) < c("limit")) == c("on_red")
    once = runs.select("sim", "net", hit.alias("hit"))
    return once.groupBy("sim").agg(F.sum(F.when(c("hit"), c("net")).otherwise(-1.0)).alias("units"), F.count_if("hit").alias("n_won"))


def monte_carlo_kelly(bouts: DataFrame, sims: int = 100, fraction: float = 0.25, start: float = 1000.0, floor: float = 100.0) -> DataFrame:
    """Quarter-Kelly bankroll paths: the bet wins if the side bet on wins in the simulation."""
    p, o = c("choice_prob"), c("choice_dec_close1")
    d = choices(bouts).withColumn("f", fraction * s.kelly_fraction(p, o)).filter("f > 0").withColumn("f", c("f") / F.count("*").over(Window.partitionBy("dt")))
    told = d.select("dt", "bout_id", "f", (c("f") * (o - 1)).alias("gain"), s.limit(p).alias("limit"))
    runs = told.select("*", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    ret = F.when(s.draw(F.lit("k"), c("sim"), c("bout_id")) < c("limit"), c("gain")).otherwise(-c("f"))
    days = runs.groupBy("sim", "dt").agg(F.sum(ret).alias("ret"))
    paths = bankroll(days, ("sim",), start, floor, floor)
    return paths.groupBy("sim").agg(F.max_by("bankroll", "dt").alias("final"), F.min("bankroll").alias("lowest"))


def simulation_summary(finals: DataFrame, column: str, start: float, by: tuple[str, ...] = ()) -> DataFrame:
    x = c(column)
    return finals.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.avg((x < start).cast("int")).alias("p_loss"), *[F.percentile(x, q / 100).alias(f"p{q}") for q in (50, 90, 95, 99)])


def rates(bouts: DataFrame, by: str = "weight_class") -> DataFrame:
    """By a column of the bouts: share of right picks and mean closing odds."""
    return choices(bouts).join(bouts.select("bout_id", by), "bout_id").groupBy(by).agg(F.avg("correct").alias("p"), F.avg("choice_dec_close1").alias("odds"))


def ruin_curve(known: DataFrame, units: int, goals: int) -> DataFrame:
    """Risk of ruin from ``units`` for every goal from 1 to ``goals``, for each row with a chance p."""
    return known.select("*", F.explode(F.sequence(F.lit(1), F.lit(goals))).alias("goal")).withColumn("ruin", s.risk_of_ruin(c("p"), F.lit(units), c("goal")))


COUNTS = ["right_count", "wrong_count"]


def _tails(p: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sample deviation of max((p o - 1) / (o - 1), 0) over sorted draws p for each o above 1: sums over the draws above
    1 / o, of their distance to the mean."""
    n, middle = len(p), p.mean()
    up = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0.0)
    at = np.searchsorted(p, 1 / odds)
    one, two, edge = up(p - middle)[at], up((p - middle) ** 2)[at], odds * middle - 1
    mean = (odds * one + (n - at) * edge) / (odds - 1) / n
    square = (odds**2 * two + 2 * odds * edge * one + (n - at) * edge**2) / (odds - 1) ** 2
    return np.where(at < n, np.maximum(mean, 0), 0.0), np.where(at < n, np.sqrt(np.maximum(square - n * mean**2, 0) / (n - 1)), 0.0)


def with_posterior_kelly(bets: DataFrame, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """Bets (right_count, wrong_count, odds and more) with kelly_mean and kelly_sd: mean and sample deviation of the Kelly
    fraction (not below 0) under Beta(1 + right, 1 + wrong).

    A posterior is drawn once for all bets that have its counts: the generator depends on the seed and the counts only. All odds
    of a posterior read the same sorted draws. So what is drawn grows with the counts that occur (with the length of
    careers), not with the bets. Posteriors are few rows and much work, so they are dealt to many tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for right, wrong, odds in b.itertuples(index=False):
                p = np.random.default_rng([seed, int(right), int(wrong)]).beta(1 + right, 1 + wrong, draws)
                odds = np.asarray(odds, dtype=float)
                mean, sd = _tails(np.sort(p), np.maximum(odds, 1 + 1e-12))
                for i in np.flatnonzero(~(odds > 1)):  # no odds at all
                    with np.errstate(all="ignore"):
                        f = np.maximum((p * odds[i] - 1) / (odds[i] - 1), 0)
                        mean[i], sd[i] = f.mean(), f.std(ddof=1)
                out.append(pd.DataFrame({"right_count": right, "wrong_count": wrong, "odds": odds, "kelly_mean": mean, "kelly_sd": sd}))
            if out:
                yield pd.concat(out)

    kinds = ", ".join(f"{x} {bets.schema[x].dataType.simpleString()}" for x in COUNTS)
    asked = bets.withColumn("odds", c("odds").cast("double"))
    each = asked.select(*COUNTS, "odds").distinct().filter("odds is not null").repartition(200, *COUNTS).groupBy(*COUNTS).agg(F.collect_list("odds").alias("odds"))
    return asked.join(each.mapInPandas(run, f"{kinds}, odds double, kelly_mean double, kelly_sd double"), [*COUNTS, "odds"], "left")


def bayesian_kelly(bets: DataFrame, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """bout_id, kelly_mean, kelly_sd of rows (bout_id, right_count, wrong_count, odds), by ``with_posterior_kelly``."""
    return with_posterior_kelly(bets.select("bout_id", *COUNTS, "odds"), draws, seed).select("bout_id", "kelly_mean", "kelly_sd")


def portfolio_bayesian_kelly(bets: DataFrame, target: float | None = 0.3, rounds: int = 1000, draws: int = 20_000, seed: int = 7) -> DataFrame:
    """Posterior Kelly stakes of rows (dt, bout_id, right_count, wrong_count, odds) under one factor a day: bets of a day
    are taken as independent, and the drawdown expected over ``rounds`` keeps to ``target``."""
    f, o = c("kelly_mean"), c("odds")
    p = s.beta_mean(c("right_count"), c("wrong_count"))
    win, lose = F.ln(1 + f * (o - 1)), F.ln(1 - f)
    mu = p * win + (1 - p) * lose
    sd = F.when(f < 1, F.sqrt(p * F.pow(win - mu, 2) + (1 - p) * F.pow(lose - mu, 2)))
    each = with_posterior_kelly(bets.select("dt", "bout_id", *COUNTS, "odds"), draws, seed).withColumn("sigma", F.coalesce(sd, F.lit(0.0)))
    day = each.withColumn("volatility", F.sqrt(F.sum(F.pow(f * c("sigma"), 2)).over(Window.partitionBy("dt"))))
    worst = c("volatility") * math.sqrt(2 * math.log(rounds))
    k = F.lit(1.0) if target is None else F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(target), worst)), F.lit(1.0))
    return day.select("dt", "bout_id", "kelly_mean", "kelly_sd", "sigma", "volatility", k.alias("k"), (k * f).alias("stake"), worst.alias("drawdown"), (k * worst).alias("drawdown_scaled"))


def portfolio_drawdowns(card: DataFrame, trials: int = 2000, rounds: int = 1000, seed: int = 7) -> DataFrame:
    """Largest drawdown of each simulated path of the bets of one card (right_count, wrong_count, odds, stake): a trial
    draws the true chances once and then plays all bets ``rounds`` times. Trials run side by side; the card, some
    dozens of bets, goes to each of them."""
    bets = card.select("right_count", "wrong_count", "odds", "stake").orderBy("right_count", "wrong_count", "odds", "stake").toPandas()
    right, wrong, odds, stake = (bets[x].to_numpy(dtype=float) for x in bets.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["id"]:
                rng = np.random.default_rng([seed, int(t)])
                p, money, peak, worst = rng.beta(1 + right, 1 + wrong), 1.0, 1.0, 0.0
                change = np.where(rng.random((rounds, len(p))) < p, stake * (odds - 1), -stake).sum(axis=1)
                for x in change:
                    money = max(money * (1 + x), 1e-12)
                    peak = max(peak, money)
                    worst = max(worst, (peak - money) / peak)
                out.append(worst)
            yield pd.DataFrame({"trial": b["id"], "drawdown": out})

    return card.sparkSession.range(trials).mapInPandas(run, "trial long, drawdown double")


def drawdown_trials(known: DataFrame, by: str, bets: int = 1000, trials: int = 2000, seed: int = 7) -> DataFrame:
    """Largest drawdown of each simulated path of equal bets, for each row (by, p, odds, f): by, trial, drawdown. The draws of
    a trial depend on the seed and its number only."""
    kind = known.select(by).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, p, odds, f in zip(b["trial"], b["p"], b["odds"], b["f"], strict=True):
                won = np.random.default_rng([seed, int(t)]).random(bets) < p
                path = np.concatenate([[0.0], np.cumsum(np.where(won, np.log1p(f * (odds - 1)), np.log1p(-f)))])
                out.append(1 - float(np.exp((path - np.maximum.accumulate(path)).min())))
            yield pd.DataFrame({by: b[by], "trial": b["trial"], "drawdown": out})

    each = known.select(by, "p", "odds", "f", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    return each.repartition(by, "trial").mapInPandas(run, f"{by} {kind}, trial int, drawdown double")


def _stakes_by_day(bets: DataFrame, cap: float) -> DataFrame:
    """Stakes of rows (dt, bout_id, p and odds: arrays by outcome). A day, one card, is one group: the optimum couples all
    of its bets, by one number a grid point."""

    def run(day: pd.DataFrame) -> pd.DataFrame:
        day = day.sort_values("bout_id")
        f = best_stakes(np.stack(day["p"]), np.stack(day["odds"]), cap)
        return pd.DataFrame({"dt": day["dt"], "bout_id": day["bout_id"], "stakes": list(f)})

    return bets.select("dt", "bout_id", "p", "odds").groupBy("dt").applyInPandas(run, "dt date, bout_id string, stakes array<double>")


def simultaneous_kelly(bouts: DataFrame, cap: float = 1.0) -> DataFrame:
    """Stakes that maximise a day's expected log wealth over all its picks of positive EV."""
    bets = choices(bouts).filter("choice_ev_close1 > 0").select("dt", "bout_id", F.array("choice_prob").alias("p"), F.array("choice_dec_close1").alias("odds"))
    return _stakes_by_day(bets, cap).select("dt", "bout_id", c("stakes")[0].alias("stake"))


def exclusive_kelly(bouts: DataFrame, cap: float = 0.15, line: str = "close1") -> DataFrame:
    """Stakes on both corners of all bouts of a day, whose wins exclude each other, at most ``cap`` a bet."""
    d = decimals(bouts)
    odds = F.array(f"dec_{line}_red", f"dec_{line}_blue")
    bets = d.select("dt", "bout_id", F.array(c("p_red"), 1 - c("p_red")).alias("p"), odds.alias("odds")).filter(F.forall("odds", lambda x: x.isNotNull()) & c("p_red").isNotNull())
    return _stakes_by_day(bets, cap).select("dt", "bout_id", c("stakes")[0].alias("stake_red"), c("stakes")[1].alias("stake_blue"))
