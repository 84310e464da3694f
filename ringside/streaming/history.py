"""Streaming mirror of the history features (an addition): records of competitors as bouts arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringside.operators.appearances import appearances

OUT = "fighter string, bout_id string, num_wins long, num_losses long, num_draws long"
STATE = "wins long, losses long, draws long"


def _records(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    w, lost, d = state.get if state.exists else (0, 0, 0)
    for b in batches:
        rows = []
        for bout, res in b.sort_values(["dt", "bout_id"])[["bout_id", "res"]].itertuples(index=False):
            rows.append((key[0], bout, w, lost, d))
            w, lost, d = w + (res == "W"), lost + (res == "L"), d + (res == "D")
        yield pd.DataFrame(rows, columns=["fighter", "bout_id", "num_wins", "num_losses", "num_draws"])
    state.update((w, lost, d))


def prefight_records(bouts: DataFrame) -> DataFrame:
    """What each competitor's record was when a bout arrived. Bouts count in order of arrival, within a batch by date."""
    long = appearances(bouts).select("fighter", "bout_id", "dt", "res")
    return long.groupBy("fighter").applyInPandasWithState(_records, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def events_per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window and type, late rows dropped after the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")
