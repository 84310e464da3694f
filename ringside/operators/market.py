"""Market tables: margin removal, line movement, choices and their profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions import market as m
from ringside.functions.staking import expected_value
from ringside.operators.tables import written

c = F.col
LINES = ("open", "close1", "close2")
CORNERS = ("red", "blue")


def decimals(bouts: DataFrame) -> DataFrame:
    cols = {f"dec_{line}_{k}": m.american_to_decimal(c(f"{line}_{k}")) for line in LINES for k in CORNERS}
    return bouts.withColumns(cols)


def devig(bouts: DataFrame, line: str = "open", method: str = "power") -> DataFrame:
    """Six columns of one line: implied and fair probabilities and fair odds of both corners."""
    d = {k: m.american_to_decimal(c(f"{line}_{k}")) for k in CORNERS}
    names = [f"{n}_{k}" for n in ("implied", "fair", "fair_odds") for k in CORNERS]
    done = bouts.withColumn("_two", m.two_way(d["red"], d["blue"], method))
    return done.select(*bouts.columns, *[c(f"_two.{n}").alias(f"{n}_{line}") for n in names])


def line_movement(bouts: DataFrame) -> DataFrame:
    moves = {f"move_{line}_{k}": c(f"open_{k}") - c(f"{line}_{k}") for line in ("close1", "close2") for k in CORNERS}
    flags = {f"{name}_{line}_{k}": f for line in ("close1", "close2") for k in CORNERS for name, f in m.movement(c(f"open_{k}"), c(f"{line}_{k}")).items()}
    return bouts.withColumns(moves | flags)


def quotes(bouts: DataFrame, lines: tuple[str, ...] = LINES, method: str = "power") -> DataFrame:
    """Each pair of American odds that occurs in one of the lines, priced once: red, blue, and two_way's fields in ``two``. An iteration
    then runs for every pair, not for every bout and line. The table is written once."""
    pair = F.inline(F.array(*[F.struct(*[c(f"{line}_{k}").alias(k) for k in CORNERS]) for line in lines]))
    dec = [m.american_to_decimal(c(k)) for k in CORNERS]
    return written(bouts.select(pair).distinct().withColumn("two", m.two_way(*dec, method)))[0]


def odds_features(bouts: DataFrame, priced: DataFrame | None = None) -> DataFrame:
    """Decimals, power-method fair values and juice of all lines, and line movement, in one pass over the bouts; prices come from a
    table of the pairs of odds that occur (``quotes``, if they are at hand)."""
    out, priced = decimals(bouts), quotes(bouts) if priced is None else priced
    names = [f"{n}_{k}" for n in ("implied", "fair", "fair_odds") for k in CORNERS]
    for line in LINES:
        kept, of = out.columns, priced.select(*[c(k).alias(f"_{k}") for k in CORNERS], c("two").alias("_two"))
        out = out.join(of, c(f"{line}_red").eqNullSafe(c("_red")) & c(f"{line}_blue").eqNullSafe(c("_blue")))
        out = out.select(*kept, *[c(f"_two.{n}").alias(f"{n}_{line}") for n in names])
    juice = {f"juice_{line}_{k}": m.juice(c(f"implied_{k}_{line}"), c(f"fair_{k}_{line}")) for line in LINES for k in CORNERS}
    return line_movement(out.withColumns(juice))


def juice_table(bouts: DataFrame) -> DataFrame:
    """Juice of the opening line, as a share of the fair probability, and what a dollar loses at fair odds."""
    d = devig(decimals(bouts), "open", "normalize")
    cols = {}
    for k in CORNERS:
        fair, imp = c(f"fair_{k}_open"), c(f"implied_{k}_open")
        cols[f"juice_{k}"] = m.juice(imp, fair)
        cols[f"juice_pct_{k}"] = F.try_divide(imp - fair, fair)
        cols[f"ev_per_dollar_{k}"] = expected_value(fair, c(f"dec_open_{k}"))
    return d.withColumns(cols).select("bout_id", *cols)


def as_probabilities(rows: DataFrame, column: str) -> DataFrame:
    """A column that holds odds if any value is over 1, else probabilities, as probabilities. The largest value is one
    row, joined to all."""
    top = rows.agg(F.max(column).alias("_top"))
    return rows.join(F.broadcast(top)).withColumn(column, F.when(c("_top") > 1, F.try_divide(F.lit(1.0), c(column))).otherwise(c(column))).drop("_top")


def fair_curve(bouts: DataFrame, bins: int = 20) -> DataFrame:
    """Fair probabilities of both corners in equal bins from the smallest to the largest: rows, mean, median and
    1 / mean. The ends are one row, joined to all."""
    d = devig(bouts, "open", "normalize").select(F.explode(F.array("fair_red_open", "fair_blue_open")).alias("p")).filter("p is not null")
    ends = d.agg(F.min("p").alias("low"), F.max("p").alias("high"))
    b = F.least(F.floor(F.coalesce(F.try_divide(c("p") - c("low"), c("high") - c("low")), F.lit(0.0)) * bins + 1e-9), F.lit(bins - 1)).cast("int")
    return (
        d.join(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.percentile("p", 0.5).alias("median_p"))
        .withColumn("fair_odds", 1 / c("mean_p"))
    )


def choices(bouts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The side a model picks: its lines in decimals, probability, EV at each line, movement, and net units. ``keep`` are columns of
    the bout, or decimal odds of its corners."""
    red = c("p_red") > 0.5
    of = lambda a: F.when(red, c(f"{a}_red")).otherwise(c(f"{a}_blue"))
    d = decimals(bouts.filter("winner in (0, 1)"))
    p = F.when(red, c("p_red")).otherwise(1 - c("p_red"))
    out = d.select(
        "bout_id", "dt", red.cast("int").alias("pred_winner"), "winner", (red.cast("int") == c("winner")).cast("int").alias("correct"), p.alias("choice_prob"),
        of("fighter").alias("choice_fighter"), *[of(line).alias(f"choice_{line}") for line in LINES], *[of(f"dec_{line}").alias(f"choice_dec_{line}") for line in LINES], *keep,
    )
    ev = {f"choice_ev_{line}": expected_value(c("choice_prob"), c(f"choice_dec_{line}")) for line in LINES}
    moves = {f"choice_move_{line}": c("choice_open") - c(f"choice_{line}") for line in ("close1", "close2")}
    net = {f"net_{line}": F.when(c("correct") == 1, c(f"choice_dec_{line}") - 1).otherwise(F.lit(-1.0)) for line in LINES}
    return out.withColumns(ev | moves | net)


def profit_by_probability(bouts: DataFrame, width: float = 0.01) -> DataFrame:
    """Mean unit profit at the first closing line by bin of predicted probability and side; no bets count as 0."""
    d = choices(bouts).withColumn("bin", F.floor(c("choice_prob") / width + 1e-9).cast("int"))
    wide = d.groupBy("bin").pivot("pred_winner", [0, 1]).agg(F.avg("net_close1"))
    return wide.select("bin", F.coalesce("0", F.lit(0.0)).alias("blue"), F.coalesce("1", F.lit(0.0)).alias("red"))


def line_cohorts(bouts: DataFrame) -> DataFrame:
    """Picks by movement class of their line: rows, mean net units, mean change of the line."""
    flags = m.movement(c("choice_open"), c("choice_close1"))
    kind = F.coalesce(*[F.when(f == 1, name) for name, f in flags.items()], F.lit("other"))
    return choices(bouts).groupBy(kind.alias("cohort")).agg(
        F.count("*").alias("n"), F.avg("net_close1").alias("mean_net"), F.avg(c("choice_close1") - c("choice_open")).alias("mean_change")
    )
