"""Point-in-time features: what was known of a competitor before a bout. No value uses the bout itself or later ones,
except the favourite counts, which by definition include the bout.

Each family is a dictionary of columns over the long form (``told``), so that a query computes one family or
``feature_table`` all of them, with the same windows: all share one partitioning and one sort."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.functions.market import red_is_favourite
from ringside.functions.parse import attempted, landed
from ringside.operators.appearances import appearances, count_prior, differences, facing, plain, prior, through, widen
from ringside.operators.sending import parts, sent
from ringside.operators.tables import written

c = F.col
Columns = dict[str, Column]
STATS = (
    "kd", "sig_str_landed", "sig_str_absorbed", "sig_str_attempted", "leg_str", "head_str", "body_str", "clinch_str", "td_landed", "td_attempted", "control", "sub_att", "reverse",
)


def bout_stats(names: tuple[str, ...]) -> dict[str, tuple[Column, Column]]:
    """(red, blue) of each statistic of a bout."""
    pair = lambda f, name: (f(c(f"{name}_red")), f(c(f"{name}_blue")))
    same = lambda x: x
    red = red_is_favourite(c("open_red"), c("open_blue"))
    every = {
        "sig_str_landed": pair(landed, "sig_str"), "sig_str_attempted": pair(attempted, "sig_str"), "sig_str_absorbed": pair(landed, "sig_str")[::-1],
        **{f"{n}_str": pair(landed, n) for n in ("leg", "head", "body", "clinch")},
        "td_landed": pair(landed, "td"), "td_attempted": pair(attempted, "td"),
        "kd": pair(same, "kd"), "control": pair(same, "ctrl"), "sub_att": pair(same, "sub_att"), "reverse": pair(same, "rev"), "fav": (red, ~red),
    }
    return {n: every[n] for n in names}


OPPONENTS = tuple(f"{s}_{x}" for s in ("sig_str", "td") for x in ("landed", "attempted"))


def told(bouts: DataFrame, stats: tuple[str, ...] = (), keep: tuple[str, ...] = (), opponents: tuple[str, ...] = (), totals: tuple[str, ...] = ()) -> DataFrame:
    """The long form with rn, the number of a bout in its competitor's history, and running totals of ``totals``."""
    long = appearances(bouts, bout_stats(stats), keep, tuple(dict.fromkeys((*opponents, *totals))))
    long = with_running_totals(long, totals) if totals else sent(long, parts(bouts), "fighter")
    return long.withColumn("rn", F.row_number().over(plain()))


def one_family(long: DataFrame, columns: Columns, diff: bool = False) -> DataFrame:
    names = list(columns)
    wide = widen(long.select("bout_id", "corner", *[v.alias(k) for k, v in columns.items()]), names)
    return differences(wide, names) if diff else wide


def _rate(hit: str, tried: str) -> Column:
    return F.try_divide(F.sum(hit).over(prior()), F.sum(tried).over(prior()))


def total_columns(names: tuple[str, ...] = STATS) -> Columns:
    seconds = F.sum("fight_seconds").over(prior())
    total = {n: F.sum(f"own_{n}").over(prior()) for n in names}
    return {k: v for n in names for k, v in ((f"{n}_total", total[n]), (f"{n}_pm", F.try_divide(total[n] * 60.0, seconds)))}


def accuracy_columns() -> Columns:
    return {f"{s}_accuracy_pct": _rate(f"own_{s}_landed", f"own_{s}_attempted") for s in ("sig_str", "td")}


def defence_columns() -> Columns:
    out = {}
    for s in ("sig_str", "td"):
        hit, tried = (F.sum(f"opp_{s}_{x}").over(prior()) for x in ("landed", "attempted"))
        out |= {f"{s}_defense_pct": 1 - F.try_divide(hit, tried), f"{s}_total_landed_against": hit, f"{s}_total_attempted_against": tried}
    return out


def with_cumulative(long: DataFrame) -> DataFrame:
    return long.withColumn("cumulative", F.coalesce(F.sum("fight_seconds").over(prior()), F.lit(0)))


def time_columns() -> Columns:
    """Over ``with_cumulative``."""
    mean = F.sum("cumulative").over(prior()) / F.count("cumulative").over(prior())
    return {"total_fight_time": c("cumulative") / 60.0, "avg_fight_time": mean / 60.0}


def month_columns() -> Columns:
    m = F.year("dt") * 12 + F.month("dt")
    return {"months_since_last": m - F.lag(m).over(plain())}


def streak_columns() -> Columns:
    run = lambda r: (c("rn") - 1 - F.coalesce(F.max(F.when(~c("res").eqNullSafe(r), c("rn"))).over(prior()), F.lit(0))).cast("long")
    won, fights = count_prior(c("res") == "W"), (c("rn") - 1).cast("long")
    return {
        "win_streak": run("W"), "lose_streak": run("L"), "num_fights": fights, "num_wins": won, "num_losses": fights - won,
        "win_pct": F.coalesce(F.try_divide(won, fights), F.lit(0.0)),
    }


METHODS = ("KO", "DEC", "SUB")  # fixed values, in order of precedence


def method_columns() -> Columns:
    return {f"{m.lower()}_wins": count_prior((c("res") == "W") & c("method").contains(m)) for m in METHODS}


def method_share_columns() -> Columns:
    kind = F.when(c("method").contains(METHODS[0]), METHODS[0]).when(c("method").contains(METHODS[1]), METHODS[1]).when(c("method").contains(METHODS[2]), METHODS[2])
    share = lambda m: F.try_divide(count_prior((c("res") == "W") & (kind == m)), count_prior(c("res").isin("W", "L") & (kind == m)))
    return {f"{m.lower()}_win_pct": F.coalesce(share(m), F.lit(0.0)) for m in METHODS}


def bonus_columns(performance_to_red: bool = True) -> Columns:
    mine = c("corner") == "red" if performance_to_red else c("res") == "W"
    return {"total_bonus": F.sum(c("fotn_bonus") + F.when(mine, c("perf_bonus")).otherwise(0)).over(prior())}


def favourite_columns() -> Columns:
    return {"fav_count": F.sum(c("own_fav").cast("int")).over(through()), "dog_count": F.sum((~c("own_fav")).cast("int")).over(through())}


RATIOS = {"td_ratio": "td_landed", "control_ratio": "control", "sig_str_ratio": "sig_str_landed"}


def with_running_totals(long: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """own_<stat>_before and opp_<stat>_before: what both had in sum before the bout. A row knows both corners' statistics, so the
    opponent's total is a window by opponent; then rows go to the fighter's, where all further windows are."""
    theirs = sent(long, parts(long), "opponent").withColumns({f"_{s}": F.sum(f"opp_{s}").over(facing()) for s in stats})
    theirs = sent(theirs, parts(long), "fighter", bits={f"_{s}": 21 for s in stats})
    own = theirs.withColumns({f"own_{s}_before": F.sum(f"own_{s}").over(prior()) for s in stats})
    return own.withColumns({f"opp_{s}_before": known_to_either(f"_{s}", f"own_{s}_before") for s in stats}).drop(*[f"_{s}" for s in stats])


def known_to_either(theirs: str, own: str) -> Column:
    """The opponent's total; 0 rather than NULL where only the own one is known."""
    return F.when(c(theirs).isNull() & c(own).isNotNull(), F.lit(0)).otherwise(c(theirs))


def ratio_columns(ratios: dict[str, str]) -> Columns:
    """Over ``with_running_totals``."""

    def ratio(stat: str) -> Column:
        own, opp = (F.coalesce(F.sum(f"{k}_{stat}_before").over(prior()), F.lit(0)) for k in ("own", "opp"))
        return F.when(c("rn") == 1, F.lit(None)).when(opp != 0, own / opp).otherwise(own.cast("double"))

    return {name: ratio(stat) for name, stat in ratios.items()}


def totals_per_minute(bouts: DataFrame, names: tuple[str, ...] = STATS) -> DataFrame:
    """<stat>_total and <stat>_pm of earlier bouts, and red - blue differences; NULL on a debut."""
    known = {f"{n}_total": F.sum(f"own_{n}").over(prior()) for n in names} | {"seconds": F.sum("fight_seconds").over(prior())}
    wide = one_family(told(bouts, names, ("fight_seconds",)), known)  # rates follow from what is sent, so they aren't sent
    corners = ("red", "blue")
    each = [x for n in names for x in (*[c(f"{n}_total_{k}") for k in corners], *[F.try_divide(c(f"{n}_total_{k}") * 60.0, c(f"seconds_{k}")).alias(f"{n}_pm_{k}") for k in corners])]
    return differences(wide.select("bout_id", *each), [f"{n}_{x}" for n in names for x in ("total", "pm")])


def accuracy(bouts: DataFrame) -> DataFrame:
    return one_family(told(bouts, ("sig_str_landed", "sig_str_attempted", "td_landed", "td_attempted")), accuracy_columns())


def defence(bouts: DataFrame) -> DataFrame:
    return one_family(told(bouts, OPPONENTS, opponents=OPPONENTS), defence_columns())


def fight_time(bouts: DataFrame) -> DataFrame:
    """Minutes fought before, 0 on a debut; and the mean of that running total over earlier bouts, NULL on a debut."""
    return one_family(with_cumulative(told(bouts, keep=("fight_seconds",))), time_columns())


def months_since_last(bouts: DataFrame) -> DataFrame:
    """Calendar months since the bout before; NULL on a debut."""
    return one_family(told(bouts), month_columns())


def streaks(bouts: DataFrame) -> DataFrame:
    """Streaks, fights, wins, losses and win share before the bout. A draw ends both streaks and counts as a loss."""
    return one_family(told(bouts), streak_columns())


def method_wins(bouts: DataFrame) -> DataFrame:
    return one_family(told(bouts, keep=("method",)), method_columns())


def method_win_share(bouts: DataFrame) -> DataFrame:
    """Wins by a method over decided bouts that ended by it; 0 without one. A method counts as the first that fits."""
    return one_family(told(bouts, keep=("method",)), method_share_columns())


def total_bonus(bouts: DataFrame, performance_to_red: bool = True) -> DataFrame:
    """Bonuses before; the performance bonus is credited to the red corner (to the winner if the flag is off)."""
    return one_family(told(bouts, keep=("perf_bonus", "fotn_bonus")), bonus_columns(performance_to_red))


def total_knockdowns(bouts: DataFrame) -> DataFrame:
    return one_family(told(bouts, ("kd",)), {"total_kd": F.sum("own_kd").over(prior())})


def cumulative_ratio(bouts: DataFrame, stat: str, name: str) -> DataFrame:
    """Sum of a competitor's own running totals over the sum of the opponents': the running totals are those known
    before each earlier bout. A zero denominator gives the numerator; NULL on a debut."""
    return one_family(told(bouts, (stat,), totals=(stat,)), ratio_columns({name: stat}))


def rolling_average(bouts: DataFrame, stat: str) -> DataFrame:
    """Mean of a statistic over earlier bouts that have it; NULL on a debut."""
    return one_family(told(bouts, (stat,)), {f"{stat}_avg": F.avg(f"own_{stat}").over(prior())})


def favourite_counts(bouts: DataFrame) -> DataFrame:
    """Bouts as favourite and as underdog, this one included."""
    return one_family(told(bouts, ("fav",)), favourite_columns())


def feature_counts() -> Columns:
    """What all families follow from: sums, counts and marks of earlier bouts, over ``with_cumulative`` and ``with_running_totals``."""
    before, known = streak_columns(), lambda x: F.sum(x).over(prior())
    kind = F.coalesce(*[F.when(c("method").contains(m), m) for m in METHODS])
    out = {f"own_{s}": known(f"own_{s}") for s in STATS} | {f"opp_{x}": known(f"opp_{x}") for x in OPPONENTS}
    out |= {"seconds": known("fight_seconds"), "cumulated": known("cumulative"), **month_columns(), **{x: before[x] for x in ("num_fights", "num_wins", "win_streak", "lose_streak")}, **method_columns()}
    for m in METHODS:
        out |= {f"first_{m}": count_prior((c("res") == "W") & (kind == m)), f"ended_{m}": count_prior(c("res").isin("W", "L") & (kind == m))}
    return out | bonus_columns() | favourite_columns() | {f"{who}_{s}_before": known(f"{who}_{s}_before") for s in RATIOS.values() for who in ("own", "opp")}


def features_of(n: Callable[[str], Column]) -> Columns:
    """All families of a corner from its counts (``n`` gives one by its name)."""
    fights, won = n("num_fights"), n("num_wins")
    out = {}
    for s in STATS:
        out |= {f"{s}_total": n(f"own_{s}"), f"{s}_pm": F.try_divide(n(f"own_{s}") * 60.0, n("seconds"))}
    out |= {f"{s}_accuracy_pct": F.try_divide(n(f"own_{s}_landed"), n(f"own_{s}_attempted")) for s in ("sig_str", "td")}
    for s in ("sig_str", "td"):
        hit, tried = n(f"opp_{s}_landed"), n(f"opp_{s}_attempted")
        out |= {f"{s}_defense_pct": 1 - F.try_divide(hit, tried), f"{s}_total_landed_against": hit, f"{s}_total_attempted_against": tried}
    out |= {"total_fight_time": F.coalesce(n("seconds"), F.lit(0)) / 60.0, "avg_fight_time": F.try_divide(n("cumulated"), F.when(fights > 0, fights)) / 60.0, "months_since_last": n("months_since_last")}
    out |= {"win_streak": n("win_streak"), "lose_streak": n("lose_streak"), "num_fights": fights, "num_wins": won, "num_losses": fights - won, "win_pct": F.coalesce(F.try_divide(won, fights), F.lit(0.0))}
    out |= {f"{m.lower()}_wins": n(f"{m.lower()}_wins") for m in METHODS}
    out |= {f"{m.lower()}_win_pct": F.coalesce(F.try_divide(n(f"first_{m}"), n(f"ended_{m}")), F.lit(0.0)) for m in METHODS}
    out |= {x: n(x) for x in ("total_bonus", "fav_count", "dog_count")}
    for name, s in RATIOS.items():
        own, opp = (F.coalesce(n(f"{who}_{s}_before"), F.lit(0)) for who in ("own", "opp"))
        out[name] = F.when(fights == 0, F.lit(None)).when(opp != 0, own / opp).otherwise(own.cast("double"))
    return out


COUNT_BITS = {"cumulated": 34, "months_since_last": 12, "seconds": 22} | {f"{who}_{s}_before": 31 for s in RATIOS.values() for who in ("own", "opp")} | {
    x: 16 for x in ("num_fights", "num_wins", "win_streak", "lose_streak", "total_bonus", "fav_count", "dog_count", *[f"{m.lower()}_wins" for m in METHODS], *[f"{k}_{m}" for k in ("first", "ended") for m in METHODS])
}


def features_from(long: DataFrame, counts: Columns) -> DataFrame:
    """One row a bout with all families of both corners and red - blue differences. Between tasks go the counts, features follow from them."""
    wide = widen(long.select("bout_id", "corner", *[v.alias(x) for x, v in counts.items()]), list(counts), bits=COUNT_BITS)
    of = {k: features_of(lambda x, k=k: c(f"{x}_{k}")) for k in ("red", "blue")}
    return differences(wide.select("bout_id", *[of[k][x].alias(f"{x}_{k}") for x in of["red"] for k in of]), list(of["red"]))


def feature_table(bouts: DataFrame) -> DataFrame:
    """All families at once, with red - blue differences: the other corner's running totals by opponent, all other windows by
    competitor, and one row a bout."""
    long = with_cumulative(told(bouts, (*STATS, "fav"), ("fight_seconds", "method", "perf_bonus", "fotn_bonus"), OPPONENTS, tuple(RATIOS.values())))
    return features_from(long, feature_counts())


def decided_differences(bouts: DataFrame, stats: tuple[str, ...]) -> DataFrame:
    """Of decided bouts what models learn from: bout_id, dt, weight_class, won (1 if red did), and red - blue differences of record, streaks,
    methods, time and rates per minute. One scan of the bouts; between tasks go counts only, rates and shares follow from them."""
    long = told(bouts, stats, ("fight_seconds", "method", "weight_class"))
    every = streak_columns() | method_columns() | {"seconds": F.sum("fight_seconds").over(prior())} | {f"{s}_total": F.sum(f"own_{s}").over(prior()) for s in stats}
    sent = [n for n in every if n not in ("num_losses", "win_pct")]
    of_red = lambda x: F.when(c("corner") == "red", x)
    rows = long.select("bout_id", "dt", "corner", of_red(c("weight_class")).alias("weight_class"), c("res").alias("res"), *[every[n].alias(n) for n in sent]).filter("res in ('W', 'L')")
    rows = rows.withColumns({"class": c("weight_class"), "won": (c("res") == "W").cast("int")})
    wide = widen(rows, ["class", "won", *sent], keep=("dt",))
    out = {}
    for k in ("red", "blue"):
        fights, wins, seconds = (c(f"{n}_{k}") for n in ("num_fights", "num_wins", "seconds"))
        of = {n: c(f"{n}_{k}") for n in sent if n not in ("seconds", *[f"{s}_total" for s in stats])}
        of |= {"num_losses": fights - wins, "win_pct": F.coalesce(F.try_divide(wins, fights), F.lit(0.0)), "total_fight_time": F.coalesce(seconds, F.lit(0)) / 60.0}
        of |= {f"{s}_pm": F.try_divide(c(f"{s}_total_{k}") * 60.0, seconds) for s in stats}
        out |= {f"{n}_{k}": v for n, v in of.items()}
    names = [n.removesuffix("_red") for n in out if n.endswith("_red")]
    return differences(wide.select("bout_id", "dt", c("class_red").alias("weight_class"), c("won_red").alias("won"), *[v.alias(n) for n, v in out.items()]), names).drop(*out)


def numbered(bouts: DataFrame) -> DataFrame:
    """With ``no``, the place in time order from 1: the bouts of earlier days, then the place within the day; NULL without a date."""
    days = bouts.groupBy("dt").agg(F.count("*").alias("n")).filter("dt is not null")  # one row a day
    line = Window.orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(c("dt").alias("day"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("dt").orderBy("bout_id"))
    dealt = sent(bouts, parts(bouts), "dt", usual=32)
    return dealt.withColumn("place", place).join(F.broadcast(before), c("dt") == c("day"), "left").withColumn("no", c("before") + c("place")).drop("place", "day", "before")


NEVER, UNDATED = np.iinfo(np.int64).max, 0


def _lists(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fighters in order, where their lists end, and the lists one after another: the other fighter, and when."""
    rows = rows.sort_values("fighter")
    join = lambda x: np.concatenate([np.asarray(v) for v in rows[x]]) if len(rows) else np.zeros(0, np.int64)
    return rows["fighter"].to_numpy(), np.cumsum([0, *map(len, rows["other"])]), join("other"), join("no")


def _complete(wins: tuple, losses: tuple, won: np.ndarray, far: np.ndarray, size: int, most: int = 1 << 22) -> np.ndarray:
    """For each pair (won, far) of fighters the earliest number at which ``won`` had beaten one who had beaten ``far``. The wins
    of a fighter are laid out over all of ``size`` fighters, and those over ``far`` are looked up in them."""
    out = np.full(len(won), NEVER)
    (winners, w_ends, beaten, then), (losers, l_ends, middle, no) = wins, losses
    w, l = np.searchsorted(winners, won), np.searchsorted(losers, far)  # noqa: E741
    known = np.flatnonzero((w < len(winners)) & (l < len(losers)))
    order = known[(winners[w[known]] == won[known]) & (losers[l[known]] == far[known])]
    order = order[np.argsort(w[order], kind="stable")]
    first, n = l_ends[l[order]], (l_ends[l[order] + 1] - l_ends[l[order]]).astype(np.int64)
    load = np.cumsum(n) // most
    cuts = np.flatnonzero((np.diff(w[order]) != 0) | (np.diff(load) != 0)) + 1 if len(order) else []
    at = np.full(size, NEVER)
    for x, y in zip([0, *cuts], [*cuts, len(order)], strict=True):
        if x == y:
            continue
        own = slice(w_ends[w[order[x]]], w_ends[w[order[x]] + 1])
        at[beaten[own]] = then[own]
        starts = np.cumsum(n[x:y]) - n[x:y]
        rows = np.arange(n[x:y].sum()) + np.repeat(first[x:y] - starts, n[x:y])
        when = np.maximum(at[middle[rows]], no[rows])
        when[when == UNDATED] = NEVER
        out[order[x:y]] = np.minimum.reduceat(when, starts)
        at[beaten[own]] = NEVER
    return out


def common_opponents(bouts: DataFrame, blocks: int = 6, most: int = 12_000_000, small: int = 2_000_000) -> DataFrame:
    """Flags: somebody whom one corner had beaten had beaten the other corner, both before this bout.

    Only pairs that fight are asked. Fighters are cut in blocks; the bouts between two blocks are one group, to which the earliest
    wins of and over the fighters of both are sent as lists of numbers, one for a fighter (each win to about two groups a block, ``blocks``
    of them, more beyond ``most`` wins a block). So wins are never paired with wins, and what is sent doesn't grow with the square of
    the wins. Up to ``small`` fighters are sent to the bouts for their numbers.
    """
    rows = bouts.select("bout_id", "dt", "fighter_red", "fighter_blue", "winner")
    known = rows.select(F.explode(F.array("fighter_red", "fighter_blue")).alias("fighter")).filter("fighter is not null").distinct()
    code, _ = written(known.select("fighter", (F.row_number().over(Window.orderBy("fighter")) - 1).alias("code")))  # one row a competitor
    size = code.count()
    of = F.broadcast(code) if size <= small else code
    for k in ("red", "blue"):
        rows = rows.join(of.select(c("fighter").alias(f"fighter_{k}"), c("code").alias(k)), f"fighter_{k}", "left").drop(f"fighter_{k}")
    rows, _ = written(numbered(rows).select("bout_id", "no", "red", "blue", "winner"))
    kind = "int" if rows.count() < 1 << 31 else "long"
    red, blue = F.struct(c("red").alias("won"), c("blue").alias("lost")), F.struct(c("blue").alias("won"), c("red").alias("lost"))
    win = F.when(c("winner") == 1, red).when(c("winner") == 0, blue)
    wins = rows.filter("red is not null and blue is not null").select(win.alias("w"), "no").filter("w is not null").select("w.won", "w.lost", "no")
    wins = sent(wins, parts(bouts), "won", usual=32).groupBy("won", "lost").agg(F.coalesce(F.min("no"), F.lit(UNDATED)).cast(kind).alias("no"))
    wins, _ = written(wins)
    many = max(blocks, -(-wins.count() // most))
    width = max(1, -(-size // many))
    block = lambda x: F.floor(x / width).cast("int")
    met = rows.withColumns({"i": F.coalesce(block(F.least("red", "blue")), F.lit(0)), "j": F.coalesce(block(F.greatest("red", "blue")), F.lit(0))})
    last = max(0, size - 1) // width
    groups = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.struct(F.least(k, block(c("fighter"))).alias("i"), F.greatest(k, block(c("fighter"))).alias("j")))

    def told(fighter: str, other: str) -> DataFrame:
        lists = wins.groupBy(c(fighter).alias("fighter")).agg(F.sort_array(F.collect_list(F.struct(c(other).alias("other"), "no"))).alias("of"))
        return lists.select(F.lit(fighter == "won").alias("won"), "fighter", c("of.other").alias("other"), c("of.no").alias("no"), F.inline(groups))

    def flags(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        wins, losses = _lists(some[some["won"]]), _lists(some[~some["won"]])
        fits = (asked["red"].notna() & asked["blue"].notna() & asked["no"].notna()).to_numpy()
        of = {x: asked[x].to_numpy()[fits].astype(np.int64) for x in ("red", "blue", "no")}
        out = pd.DataFrame({"bout_id": asked["bout_id"], "mma_math_red": 0, "mma_math_blue": 0})
        for corner, (won, far) in {"red": ("red", "blue"), "blue": ("blue", "red")}.items():
            flag = np.zeros(len(asked), dtype=np.int32)
            flag[fits] = _complete(wins, losses, of[won], of[far], size) < of["no"]
            out[f"mma_math_{corner}"] = flag
        return out

    tasks = max(parts(bouts), 2 * many * (many + 1))
    every = told("won", "lost").unionByName(told("lost", "won")).repartition(tasks, "i", "j")
    asked = sent(met, tasks, "i", "j", usual=32)
    id_type = bouts.schema["bout_id"].dataType.simpleString()
    return every.groupBy("i", "j").cogroup(asked.groupBy("i", "j")).applyInPandas(flags, f"bout_id {id_type}, mma_math_red int, mma_math_blue int")


def right_wrong_counts(bouts: DataFrame) -> DataFrame:
    """Of earlier picks of the fighter picked here: how many were right, how many wrong. Draws decide nothing."""
    pick = (c("p_red") > 0.5).cast("int")
    picks = bouts.filter("winner in (0, 1)").select(
        "bout_id", "dt", F.when(pick == 1, c("fighter_red")).otherwise(c("fighter_blue")).alias("fighter"), (pick == c("winner")).alias("right")
    )
    return picks.select("bout_id", c("fighter").alias("choice_fighter"), count_prior(c("right")).alias("right_count"), count_prior(~c("right")).alias("wrong_count"))


def prefight_core(bouts: DataFrame) -> DataFrame:
    """The flagship: record, streak and striking rate of both corners before each bout, with differences."""
    every = streak_columns() | total_columns(("sig_str_landed",))
    names = ("num_wins", "num_losses", "win_streak", "sig_str_landed_pm")
    return one_family(told(bouts, ("sig_str_landed",), ("fight_seconds",)), {n: every[n] for n in names}, diff=True)
