"""Value, Kelly and risk as Column functions. Odds are decimal unless named american."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringside.functions.market import american_to_decimal

MDD_STEPS = 14  # halvings of [0, 1] to a tolerance of 1e-4


def expected_value(p: Column, odds: Column) -> Column:
    return p * (odds - 1) - (1 - p)


def flat_profit(american: Column, won: Column, wager: float) -> Column:
    """Profit of a flat stake at American odds; minus the stake if the pick lost."""
    return F.when(won, (american_to_decimal(american) - 1) * wager).otherwise(F.lit(-float(wager)))


def gross(american: Column, won: Column, wager: float) -> Column:
    """What comes back: stake and profit, or nothing."""
    return F.when(won, american_to_decimal(american) * wager).otherwise(F.lit(0.0))


def expected_winnings(p: Column, american: Column, wager: float) -> Column:
    return p * (american_to_decimal(american) - 1) * wager - (1 - p) * wager


def kelly_criterion(p: Column, american: Column) -> Column:
    """p - (1 - p) / b, negative if there is no edge; 0 for a missing line."""
    b = american_to_decimal(american) - 1
    return F.when(american.isNull() | (american == 0), F.lit(0.0)).otherwise(p - F.try_divide(1 - p, b))


def kelly_fraction(p: Column, odds: Column) -> Column:
    b = odds - 1
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.greatest(F.try_divide(b * p - (1 - p), b), F.lit(0.0)))


def kelly_edge(p: Column, fair_odds: Column) -> Column:
    return p - F.try_divide(F.lit(1.0), fair_odds)


def beta_mean(right: Column, wrong: Column) -> Column:
    """Posterior mean of Beta(1 + right, 1 + wrong)."""
    return (1 + right) / (2 + right + wrong)


def beta_variance(right: Column, wrong: Column) -> Column:
    a, b = 1 + right, 1 + wrong
    return a * b / ((a + b) * (a + b) * (a + b + 1))


def bayesian_edge(p: Column, fair_odds: Column, right: Column, wrong: Column) -> Column:
    """The edge against fair odds raised by a quarter of one minus the posterior variance."""
    return p - F.try_divide(F.lit(1.0), fair_odds + 0.25 * (1 - beta_variance(right, wrong)))


def log_growth(p: Column, odds: Column, f: Column) -> Column:
    """Expected log growth; NULL at f >= 1, where a loss ruins."""
    return F.when(f < 1, p * F.ln(1 + f * (odds - 1)) + (1 - p) * F.ln(1 - f))


def log_return_sd(p: Column, odds: Column, f: Column) -> Column:
    """Standard deviation of the log return of a bet of the fraction f."""
    return F.when(f < 1, F.sqrt(p * (1 - p)) * (F.ln(1 + f * (odds - 1)) - F.ln(1 - f)))


def expected_max_drawdown(sd: Column, bets: Column) -> Column:
    return sd * F.sqrt(2 * F.ln(bets))


def drawdown_scale(p: Column, odds: Column, f: Column, bets: Column, cap: float) -> Column:
    """The largest k in [0, 1], within 1e-4, whose bet k f keeps the expected drawdown within the cap."""

    def step(seen: Column, _: Column) -> Column:
        k = (seen["low"] + seen["high"]) / 2
        fits = F.coalesce(expected_max_drawdown(log_return_sd(p, odds, k * f), bets) <= cap, F.lit(False))
        return F.struct(F.when(fits, k).otherwise(seen["low"]).alias("low"), F.when(fits, seen["high"]).otherwise(k).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MDD_STEPS)), start, step, lambda s: s["low"])


def risk_of_ruin(p: Column, units: Column, goal: Column) -> Column:
    """Gambler's ruin: from ``units``, the chance to lose all before winning ``goal``; at p = 1/2 its limit."""
    r = (1 - p) / p
    ruin = (F.pow(r, units) - F.pow(r, units + goal)) / (1 - F.pow(r, units + goal))
    return F.when(p == 0.5, goal / (units + goal)).otherwise(ruin)


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that a key fixes: the first 32 bits of its MD5. The same in every engine and every rerun."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8), 16, 10).cast("double") / math.pow(2, 32)


def draw(*key: Column) -> Column:
    """The digest behind ``uniform``: it stands before ``limit(p)`` where the number is less than p."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))


def limit(p: Column) -> Column:
    """p * 2 ** 32, rounded up, in 8 digits as digests have them; so that no draw is turned into a number."""
    first = F.ceil(p * math.pow(2, 32)).cast("long")
    return F.when(p <= 0, F.lit("")).when((p >= 1) | (first >= 1 << 32), F.lit("g")).otherwise(F.lower(F.lpad(F.hex(first), 8, "0")))
