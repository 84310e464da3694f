"""Odds, margins and line movement as Column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 50  # halvings of a bisection: to about 1e-15
NEWTON = 12  # steps of Newton's method on a convex function: ten are enough for odds up to 250


def american_to_decimal(odds: Column) -> Column:
    return F.when(odds > 0, odds / 100 + 1).otherwise(F.try_divide(F.lit(100.0), F.abs(odds)) + 1)


def implied(decimal: Column) -> Column:
    return F.try_divide(F.lit(1.0), decimal)


def normalized(p: Column, q: Column) -> tuple[Column, Column]:
    """Both probabilities over their sum; NULL unless the sum is positive."""
    total = F.when(p + q > 0, p + q)
    return p / total, q / total


def _bisect(low: float, high: float, too_low: Callable[[Column], Column]) -> Column:
    """The point between low and high below which ``too_low`` holds; it is evaluated once a step."""
    pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))

    def step(seen: Column, _: Column) -> Column:
        middle = (seen["low"] + seen["high"]) / 2
        return F.when(too_low(middle), pair(middle, seen["high"])).otherwise(pair(seen["low"], middle))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), pair(F.lit(low), F.lit(high)), step, lambda s: (s["low"] + s["high"]) / 2)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once for all its uses in the body."""
    return F.transform(F.array(value), body)[0]


def power(p: Column, q: Column) -> tuple[Column, Column]:
    """p ** a and q ** a with the a (0 to 5) that makes them sum to 1, then normalised. The sum is convex in a and falls,
    so that Newton's method comes from 0 up to the root without passing it."""

    def step(a: Column, _: Column) -> Column:
        x, y = F.pow(p, a), F.pow(q, a)
        return F.least(a - (x + y - 1) / (x * F.ln(p) + y * F.ln(q)), F.lit(5.0))

    a = F.when(F.greatest(p, q) < 1, F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.lit(0.0), step)).otherwise(F.lit(5.0))
    both = _let(F.when(p.isNotNull() & q.isNotNull(), a), lambda a: F.struct(F.pow(p, a).alias("p"), F.pow(q, a).alias("q")))
    return both["p"], both["q"]


def shin(p: Column, q: Column) -> tuple[Column, Column]:
    """Shin (1993): fair probabilities under a share z of insiders, z by bisection; sums to 1 by normalising at last.

    An under-round market (implied sum below 1) has z = 0.
    """
    total = p + q

    def root(square: Column, z: Column) -> Column:
        return F.sqrt(z * z + 4 * (1 - z) * square)

    squares = F.struct((p * p / total).alias("p"), (q * q / total).alias("q"))
    # the fair probabilities (root - z) / (2 (1 - z)) sum to more than 1 exactly when the roots sum to more than 2
    z = _let(squares, lambda s: _bisect(0.0, 0.5, lambda m: root(s["p"], m) + root(s["q"], m) > 2))
    both = _let(F.when(p.isNotNull() & q.isNotNull(), z), lambda z: F.struct((root(p * p / total, z) - z).alias("p"), (root(q * q / total, z) - z).alias("q")))
    return both["p"], both["q"]


METHODS = {"normalize": lambda p, q: (p, q), "power": power, "shin": shin}


def two_way(red_decimal: Column, blue_decimal: Column, method: str = "power") -> Column:
    """STRUCT of implied and fair probabilities and fair odds of both corners. Each step is bound to a variable, so that
    a bisection runs once a row however many fields are read."""

    def told(s: Column, fair: Column) -> Column:
        a, b = normalized(fair["p"], fair["q"])
        return F.struct(
            s["p"].alias("implied_red"), s["q"].alias("implied_blue"), a.alias("fair_red"), b.alias("fair_blue"),
            implied(a).alias("fair_odds_red"), implied(b).alias("fair_odds_blue"),
        )

    def fair(s: Column) -> Column:
        a, b = METHODS[method](s["p"], s["q"])
        return F.struct(a.alias("p"), b.alias("q"))

    prices = F.struct(implied(red_decimal).alias("p"), implied(blue_decimal).alias("q"))
    return _let(prices, lambda s: _let(fair(s), lambda f: told(s, f)))


def juice(implied_p: Column, fair_p: Column) -> Column:
    return implied_p - fair_p


def movement(opening: Column, closing: Column) -> dict[str, Column]:
    """How a corner's line moved, as 0/1 flags; NULL odds are 0."""
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return {
        "dog_to_fav": flag((opening > 0) & (closing < 0)),
        "stayed_fav": flag((opening < 0) & (closing < 0)),
        "fav_to_dog": flag((opening < 0) & (closing > 0)),
        "stayed_dog": flag((opening > 0) & (closing > 0)),
    }


def red_is_favourite(open_red: Column, open_blue: Column) -> Column:
    """The lower American line; a tie goes to red, missing odds to blue."""
    return F.coalesce(open_red <= open_blue, F.lit(False))
