"""Ratings in slices of time against one pass in order."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.operators import rating, slices

SCHEMA = "bout_id string, dt date, fighter_red string, fighter_blue string, winner int, outcome int, margin double, division string, dt2 string"


def bouts(spark, n=360, fighters=14, hot=True):
    """Bouts of 40 days; one fighter is in a third of them, some start late, some results, names, days and divisions are null."""
    rnd, rows = random.Random(5), []
    for i in range(n):
        late = fighters if i > n // 2 else fighters - 4
        a, b = rnd.sample(range(late), 2)
        a = 0 if hot and i % 3 == 0 and b != 0 else a
        day = None if i < 3 else dt.date(2020, 1, 1) + dt.timedelta(i * 40 // n)
        won = rnd.choice([0, 1, 1, 2, None])
        rows.append((f"{i:05}", day, None if i % 97 == 5 else f"F{a}", f"F{b}", won, won if won in (0, 1) else None, float(rnd.randint(0, 9)), rnd.choice(["x", "", None]), "extra"))
    return spark.createDataFrame(rows, SCHEMA).withColumn("moment", F.concat(F.col("dt").cast("string"), F.lit("|"), F.col("bout_id")))


KINDS = {
    "elo": lambda b, part=None, **s: rating.elo(b, part, **s),
    "glicko": lambda b, part=None, **s: rating.glicko(b, part, **s),
    "glicko2": lambda b, part=None, **s: rating.glicko2(b, part, **s),
    "both": lambda b, part=None, **s: rating.elo_and_glicko(b, part, **s),
    "margin": lambda b, part=None, **s: rating.margin_elo(b, part, s, margin="log", cutoff=1510.0, season=40, regress=0.1),
}


def told(df):
    return {r["bout_id"]: tuple(r) for r in df.collect()}


@pytest.mark.parametrize("kind", list(KINDS))
def test_slices_equal_one_pass(spark, kind):
    b = bouts(spark)
    whole, cut = told(KINDS[kind](b, span=10**6)), told(KINDS[kind](b, span=12))
    assert len(whole) == len(cut) == 360
    assert all(cut[i] == pytest.approx(whole[i], abs=1e-9) if kind == "margin" else cut[i] == whole[i] for i in whole)


def test_parts_are_apart(spark):
    b = bouts(spark, 200)
    cut = {r["bout_id"]: r for r in rating.glicko(b, "division", span=12).collect()}
    for name in ("x", "", None):
        alone = told(rating.glicko(b.filter(F.col("division").eqNullSafe(F.lit(name))), span=10**6))
        assert alone and all((*[cut[i][x] for x in ("bout_id", *rating.GLICKO)], cut[i]["division"]) == (*alone[i], name) for i in alone)


def test_no_bouts_and_one_day(spark):
    b = bouts(spark, 60)
    assert rating.elo(b.limit(0)).collect() == []
    day = b.withColumn("dt", F.lit(dt.date(2020, 1, 1))).withColumn("moment", F.col("bout_id"))
    assert told(rating.elo(day, span=4)) == told(rating.elo(day))


def test_tolerance_bounds_the_error(spark):
    b = bouts(spark, 240, hot=False)
    whole, near = told(rating.elo(b)), told(rating.elo(b, span=10, tolerance=1e-3))
    assert all(near[i][1:] == pytest.approx(whole[i][1:], abs=0.05) for i in whole)


def test_seasons_touch_only_those_who_fight():
    """A season's end moves no table of all ratings; what it missed is applied when a rating is read."""
    table = rating.Elo(season=1, regress=0.1)
    for i in range(500):
        table.load(f"F{i}", [1500.0 + i, 0.0])
    kept = dict(table.rating)
    for _ in range(3):
        table.step("A", "B", 1.0)
    assert {f: r for f, r in table.rating.items() if f in kept} == kept
    assert table.now("F400") == pytest.approx(1500 + 400 * 0.9**3, abs=1e-9) and table.ratings()["F0"] == 1500


def test_many_settings_at_once_equal_one_by_one(spark):
    """Waves of matches under several settings against Elo match by match; and no row a match and setting is made."""
    rnd, settings = random.Random(3), [r.asDict() for r in rating.grid(spark, mov_mode=["log", "sqrt"], cutoff_rating=[None, 1510.0], cutoff_k_scale=[0.5], w90=[None, 300.0], regress_to_mean=[0.1], regress_every=[None, 7]).collect()]
    games = [(rnd.randrange(9), rnd.randrange(9, 14), rnd.choice([0.0, 1.0, 1.0, None]), float(rnd.randrange(5))) for _ in range(400)]
    many = rating.ManyElos(settings, 14)
    for x in range(0, 400, 130):
        red, blue, won, margin = (np.array([g[i] for g in games[x : x + 130]], dtype=t) for i, t in enumerate((np.int32, np.int32, float, float)))
        many.play(red, blue, won, margin)
    for j, s in enumerate(settings):
        one = rating.Elo(s["base_k"], rating.scale_of_w90(s["w90"]) if s["w90"] else rating.SCALE, s["mov_mode"], s["cutoff_rating"], s["cutoff_k_scale"], s["regress_every"] or 0, s["regress_to_mean"])
        for red, blue, won, margin in games:
            one.step(red, blue, won, margin)
        assert [one.now(f) for f in range(14)] == pytest.approx(list(many.all_now()[:, j]), abs=1e-9)
    b = bouts(spark).withColumn("moment", F.coalesce("moment", "bout_id"))
    search = rating.grid_search(b, rating.grid(spark, base_k=[10.0, 20.0, 30.0]), together=2)
    assert len(search.collect()) == 3 and "expected" not in search._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", list(KINDS))
def test_tasks_of_slices_get_packed_numbers(spark, kind, monkeypatch):
    """A task orders rows of many bouts each, not one by one with their texts; a small ``most`` cuts the ordering and changes nothing."""
    made = []
    packed = slices._packed
    monkeypatch.setattr(slices, "_packed", lambda *a: made.append(packed(*a)) or made[-1])
    b = bouts(spark).drop("moment").filter("dt is not null")
    whole, cut = told(KINDS[kind](b)), told(KINDS[kind](b, most=50, span=12))
    assert len(cut) == 357 and all(cut[i] == pytest.approx(whole[i], abs=1e-9) for i in whole)
    assert made[0].count() <= 4 and made[1].count() < 60
    assert sum(len(r["red"]) for r in made[1].collect()) == 357 * 4
