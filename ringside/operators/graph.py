"""The fight graph: competitors as vertices, two directed edges a bout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.operators.appearances import appearances
from ringside.operators.audit import chronological_split

c = F.col


def edges(bouts: DataFrame, train_share: float = 0.85) -> DataFrame:
    """src, dst, at, label (1 on the winner's edge) and train mask of decided bouts."""
    decided = chronological_split(bouts.filter("winner in (0, 1)"), train_share)
    return decided.select(
        "bout_id", "dt", "is_train",
        F.inline(F.array(*[F.struct(c(f"fighter_{a}").alias("src"), c(f"fighter_{b}").alias("dst"), (c("winner") == w).cast("int").alias("label")) for a, b, w in (("red", "blue", 1), ("blue", "red", 0))])),
    )


def vertices(bouts: DataFrame) -> DataFrame:
    """The latest known features of each competitor: the last bout wins."""
    stats = {"kd": (c("kd_red"), c("kd_blue")), "ctrl": (c("ctrl_red"), c("ctrl_blue"))}
    a = appearances(bouts, stats, keep=("moment", "fight_seconds"))
    return a.groupBy("fighter").agg(F.max(F.struct("moment", "own_kd", "own_ctrl", "fight_seconds")).alias("v"), F.count("*").alias("n_bouts")).select("fighter", "n_bouts", "v.own_kd", "v.own_ctrl", "v.fight_seconds")


def edge_lookup(wanted: DataFrame, all_edges: DataFrame) -> DataFrame:
    """The first edge of each (src, dst, dt) asked for."""
    return wanted.join(all_edges.groupBy("src", "dst", "dt").agg(F.min(F.struct("bout_id", "label")).alias("e")), ["src", "dst", "dt"], "left").select("src", "dst", "dt", "e.bout_id", "e.label")
