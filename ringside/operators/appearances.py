"""The long form of bouts: one row for each competitor of a bout, and windows over a competitor's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ringside.operators.sending import parts, sent

ORDER = ("dt", "bout_id")


def prior() -> WindowSpec:
    """All earlier bouts of a competitor."""
    return plain().rowsBetween(Window.unboundedPreceding, -1)


def facing() -> WindowSpec:
    """All earlier bouts of the opponent; such rows hold the opponent's statistics as those of the other corner."""
    return Window.partitionBy("opponent").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)


def through() -> WindowSpec:
    """All earlier bouts and this one."""
    return plain().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def plain() -> WindowSpec:
    return Window.partitionBy("fighter").orderBy(*ORDER)


def appearances(bouts: DataFrame, stats: dict[str, tuple[Column, Column]] | None = None, keep: tuple[str, ...] = (), opponents: tuple[str, ...] = ()) -> DataFrame:
    """Two rows a bout in one scan: corner, fighter, opponent, res (W, L, D; NULL if unknown), own_<name> for each entry
    (red, blue) of ``stats`` and opp_<name> for those named in ``opponents``. ``keep`` are columns of the bout itself.
    Statistics are computed before a bout becomes two rows, so that a text is parsed once for both corners."""
    stats = stats or {}
    corners = ("red", "blue")
    parsed = {f"{n}_of_{k}": v[j] for n, v in stats.items() for j, k in enumerate(corners)}

    def side(corner: str) -> Column:
        me, other = corners if corner == "red" else corners[::-1]
        won = 1 if corner == "red" else 0
        res = F.when(F.col("winner") == won, "W").when(F.col("winner") == 1 - won, "L").when(F.col("winner") == 2, "D")
        return F.struct(
            F.lit(corner).alias("corner"), F.col(f"fighter_{me}").alias("fighter"), F.col(f"fighter_{other}").alias("opponent"), res.alias("res"),
            *[F.col(f"{n}_of_{me}").alias(f"own_{n}") for n in stats], *[F.col(f"{n}_of_{other}").alias(f"opp_{n}") for n in opponents if n in stats],
        )

    once = bouts.select("bout_id", "dt", "fighter_red", "fighter_blue", "winner", *keep, *[v.alias(n) for n, v in parsed.items()])
    return once.select("bout_id", "dt", *keep, F.inline(F.array(side("red"), side("blue"))))


def widen(long: DataFrame, names: list[str], keep: tuple[str, ...] = (), bits: dict[str, int] | None = None) -> DataFrame:
    """Back to one row a bout: <name>_red and <name>_blue. Rows are dealt by bout before they are widened: no two rows of a bout lie
    together before, so that sums made there would only send every column twice. Numbers travel packed (``bits``, 21 if not named)."""
    at = lambda corner, n: F.max(F.when(F.col("corner") == corner, F.col(n))).alias(f"{n}_{corner}")
    return sent(long, parts(long), "bout_id", bits=bits, usual=21).groupBy("bout_id").agg(*[F.first(c).alias(c) for c in keep], *[at(c, n) for n in names for c in ("red", "blue")])


def differences(wide: DataFrame, names: list[str]) -> DataFrame:
    """Add <name>_diff = red - blue."""
    return wide.select("*", *[(F.col(f"{n}_red") - F.col(f"{n}_blue")).alias(f"{n}_diff") for n in names])


def count_prior(condition: Column) -> Column:
    """How many earlier rows meet the condition; 0 on a debut."""
    return F.coalesce(F.sum(F.when(condition, 1)).over(prior()), F.lit(0)).cast("long")
