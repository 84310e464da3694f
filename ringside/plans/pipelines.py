"""Whole jobs: building the feature table, and the back-test."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.functions import parse as p
from ringside.operators import bankroll, history, market, rating
from ringside.operators.match import band_join
from ringside.operators.sending import parts as count
from ringside.operators.sending import sent

c = F.col


def parse_corner(k: str, reference_year: int) -> list[Column]:
    """The parsers of one corner of raw bouts."""
    other = "blue" if k == "red" else "red"
    return [
        p.height_inches(c(f"height_{k}")).alias(f"height_{k}"), p.reach_inches(c(f"reach_{k}")).alias(f"reach_{k}"),
        p.years_before(c(f"dob_{k}"), reference_year).alias(f"age_{k}"), p.wins(c(f"record_{k}")).alias(f"wins_{k}"), p.losses(c(f"record_{k}")).alias(f"losses_{k}"),
        p.landed(c(f"sig_str_{k}")).alias(f"sig_str_landed_{k}"), p.attempted(c(f"sig_str_{k}")).alias(f"sig_str_attempted_{k}"),
        p.percent(c(f"sig_str_percent_{k}")).alias(f"sig_str_pct_{k}"), p.strike_defence(c(f"sig_str_percent_{other}")).alias(f"str_defense_{k}"),
        p.percent(c(f"td_pct_{k}")).alias(f"td_pct_{k}"), p.takedown_defence(c(f"td_pct_{other}")).alias(f"td_defense_{k}"),
        p.clock_minutes(c(f"ctrl_{k}")).alias(f"ctrl_{k}"), p.landed(c(f"sig_str_{other}")).alias(f"sig_str_absorbed_{k}"),
        *[p.landed(c(f"{n}_{k}")).alias(f"{n}_str_{k}") for n in ("leg", "head", "body", "clinch")],
        p.landed(c(f"td_{k}")).alias(f"td_landed_{k}"), p.attempted(c(f"td_{k}")).alias(f"td_attempted_{k}"),
        *[p.to_int(c(f"{n}_{k}")).alias(f"{name}_{k}") for n, name in (("kd", "kd"), ("sub_att", "sub_att"), ("rev", "reverse"))],
    ]


def single_event_features(raw: DataFrame, reference_year: int) -> DataFrame:
    """Raw bouts to numbers in one select; rates per minute of the final round's clock, as given. Ages are counted to the
    reference year, the event's age in days to its first day."""
    reference = F.make_date(F.lit(reference_year), F.lit(1), F.lit(1))
    minutes = p.clock_minutes(c("fight_time"))
    out = raw.select(
        "bout_id", p.country(c("event_location")).alias("event_country"), p.days_before(p.any_date(c("event_date")), reference).alias("event_age_days"),
        (reference_year - F.year(p.any_date(c("event_date")))).alias("event_age"), c("title_fight").try_cast("double").alias("title_fight"), p.womens(c("weight_class")).alias("womens_fight"), minutes.alias("fight_minutes"),
        *parse_corner("red", reference_year), *parse_corner("blue", reference_year),
    )
    rates = {f"{n}_{a}": F.try_divide(c(f"sig_str_landed_{b}"), c("fight_minutes")) for n, pair in (("slpm", (("red", "red"), ("blue", "blue"))), ("sapm", (("red", "blue"), ("blue", "red")))) for a, b in pair}
    diffs = {f"{n}_diff": c(f"{n}_red") - c(f"{n}_blue") for n in ("height", "reach", "age")}
    return out.withColumns(rates | diffs)


def upcoming_features(card: DataFrame, reference_year: int) -> DataFrame:
    """The parsers that an upcoming card has columns for; everything else joins as NULL by name."""
    of = lambda f, n: [f(c(f"{n}_{k}")).alias(f"{n}_{k}") for k in ("red", "blue")]
    ages = [p.years_before(c(f"dob_{k}"), reference_year).alias(f"age_{k}") for k in ("red", "blue")]
    kept = [x for x in card.columns if not x.startswith(("height_", "reach_", "dob_"))]
    return card.select(*kept, *of(p.height_inches, "height"), *of(p.reach_inches, "reach"), *ages, c("event_date").alias("dt"), F.lit(True).alias("is_upcoming"))


def build_features(bouts: DataFrame, odds: DataFrame | None = None) -> DataFrame:
    """Every feature of every bout in one wide table, with odds features and, if given, odds joined within a day.

    Four parts each scan the bouts (some more than once): all families of history, both ratings in order, common
    opponents, and for what a bout itself tells. What they write is written side by side: rounds of ratings leave most
    of a cluster idle. All four meet by bout_id. Bouts are dealt by it before a bout's own columns are added, so that these
    aren't sent, and tables of one file part are widened by all tasks.
    """
    parts = (lambda b: market.odds_features(sent(b, count(b), "bout_id", usual=17), market.quotes(b)), history.feature_table, rating.elo_and_glicko, history.common_opponents)
    with ThreadPoolExecutor(len(parts)) as pool:
        run = [pool.submit(inheritable_thread_target(bouts.sparkSession)(f), bouts) for f in parts]
        own, *others = [x.result() for x in run]
    wide = reduce(lambda a, b: a.join(b, "bout_id"), others, own.withColumn("womens_fight", p.womens(c("weight_class"))))
    return band_join(wide, odds) if odds is not None else wide


def backtest(bouts: DataFrame, mode: str = "per_bet") -> DataFrame:
    """Predictions to a bankroll a day, with the day's profit beside it."""
    days = bankroll.simulate_kelly(bouts, mode)
    return days.join(bankroll.profit_by_day(bouts).select("dt", c("profit").alias("flat_profit")), "dt", "left")
