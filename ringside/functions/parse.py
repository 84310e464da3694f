"""Scraped strings to numbers, dates and names. Every function maps a Column to a Column; what can't be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TD_DEFENCE_PRIOR = 0.55  # fixed value: defence of a fighter whose takedown percentage is missing
DATE_FORMATS = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d, yyyy")  # fixed values


def to_int(c: Column) -> Column:
    return c.try_cast("int")


def landed(c: Column) -> Column:
    """17 of "17 of 42"."""
    return to_int(F.split(c, " of ")[0])


def attempted(c: Column) -> Column:
    return to_int(F.try_element_at(F.split(c, " of "), F.lit(2)))


def thrown(c: Column) -> Column:
    return F.struct(landed(c).alias("landed"), attempted(c).alias("attempted"))


def percent(c: Column) -> Column:
    """0.43 of "43%"; "---" is NULL."""
    return F.rtrim(c, F.lit("%")).try_cast("double") / 100


def strike_defence(opponent_percent: Column) -> Column:
    return 1 - percent(opponent_percent)


def takedown_defence(opponent_percent: Column) -> Column:
    """A missing percentage gets the prior, not NULL."""
    return F.when(opponent_percent == "---", TD_DEFENCE_PRIOR).otherwise(1 - percent(opponent_percent))


def clock_seconds(c: Column) -> Column:
    """210 of "3:30"."""
    part = F.split(c, ":")
    return to_int(part[0]) * 60 + to_int(F.try_element_at(part, F.lit(2)))


def clock_minutes(c: Column) -> Column:
    return clock_seconds(c) / 60


def height_inches(c: Column) -> Column:
    """73 of 6' 1"."""
    pattern = r"(\d+)' (\d+)"
    return to_int(F.regexp_extract(c, pattern, 1)) * 12 + to_int(F.regexp_extract(c, pattern, 2))


def reach_inches(c: Column) -> Column:
    return to_int(F.trim(F.replace(c, F.lit('"'), F.lit(""))))


def wins(record: Column) -> Column:
    return to_int(F.split(record, "-")[0])


def losses(record: Column) -> Column:
    return to_int(F.try_element_at(F.split(record, "-"), F.lit(2)))


def any_date(c: Column) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in DATE_FORMATS])


def days_before(date: Column, reference: Column) -> Column:
    return F.date_diff(reference, date)


def is_long_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("MMMM d, yyyy")).isNotNull()


def years_before(c: Column, reference_year: int) -> Column:
    """Age in calendar years at a given year (never the year in which the code happens to run)."""
    return F.lit(reference_year) - F.year(any_date(c))


def country(location: Column) -> Column:
    """The last part after a comma; its leading space stays."""
    return F.element_at(F.split(location, ","), -1)


def split_comma(c: Column) -> Column:
    """[before, after] the first comma, trimmed; after is NULL without a comma."""
    part = F.split(c, ",", 2)
    return F.array(F.trim(part[0]), F.trim(F.try_element_at(part, F.lit(2))))


def clean_text(c: Column) -> Column:
    """Lower case, hyphens as spaces, no dots or apostrophes."""
    return F.translate(F.lower(c), "-.'", " ")


def clean_name(c: Column) -> Column:
    """clean_text, and "saint" as "st"."""
    return F.regexp_replace(clean_text(c), r"\bsaint\b", "st")


def winner_code(winner: Column, red: Column, blue: Column) -> Column:
    """1 red, 0 blue, 2 draw or no contest, NULL if unknown."""
    return F.when(winner == red, 1).when(winner == blue, 0).when(F.upper(winner).isin("NC", "DRAW", "D"), 2)


def winner_name(status: Column, red: Column, blue: Column) -> Column:
    """The scraped status of the red corner: W, L, NC or D."""
    return F.when(status == "W", red).when(status == "L", blue).when(F.upper(status) == "NC", "NC").otherwise("DRAW")


def womens(weight_class: Column) -> Column:
    return F.lower(weight_class).contains("women").cast("int")


def partial_match(a: Column, b: Column) -> Column:
    """Every character of one name stands somewhere in the other."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    within = lambda x, y: F.size(F.array_except(chars(x), chars(y))) == 0
    return within(a, b) | within(b, a)


def token_match(a: Column, b: Column) -> Column:
    """Every word of one name stands in the other."""
    words = lambda c: F.array_distinct(F.split(clean_name(c), r"\s+"))
    within = lambda x, y: F.size(F.array_except(words(x), words(y))) == 0
    return within(a, b) | within(b, a)


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
