"""Hand-computed cases, invariants and plain loops for the library's own operators."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ringside.functions import market, parse, staking
from ringside.operators import audit, bankroll, evaluation, history, learn, match, rating, stakes
from ringside.operators import market as tables
from ringside.plans import queries as plans
from ringside.sources import bouts as src

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def view(spark):
    return src.bouts_view(spark, SMALL).persist()


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()[0]


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: parse.landed(F.lit("17 of 42")), 17), (lambda: parse.attempted(F.lit("17 of 42")), 42), (lambda: parse.attempted(F.lit("17")), None), (lambda: parse.percent(F.lit("43%")), 0.43),
        (lambda: parse.percent(F.lit("---")), None), (lambda: parse.takedown_defence(F.lit("---")), 0.55), (lambda: parse.clock_seconds(F.lit("3:30")), 210), (lambda: parse.clock_seconds(F.lit("--")), None),
        (lambda: parse.height_inches(F.lit("6' 1\"")), 73), (lambda: parse.height_inches(F.lit("--")), None), (lambda: parse.reach_inches(F.lit('72"')), 72), (lambda: parse.reach_inches(F.lit("--")), None),
        (lambda: parse.wins(F.lit("20-3-0")), 20), (lambda: parse.losses(F.lit("20-3-0")), 3), (lambda: parse.any_date(F.lit("Aug 20, 1997")), dt.date(1997, 8, 20)),
        (lambda: parse.any_date(F.lit("April 5, 2024")), dt.date(2024, 4, 5)), (lambda: parse.any_date(F.lit("--")), None), (lambda: parse.years_before(F.lit("Aug 20, 1997"), 2025), 28),
        (lambda: parse.country(F.lit("Las Vegas, Nevada, USA")), " USA"), (lambda: parse.clean_name(F.lit("Saint-Denis O'Neil Jr.")), "st denis oneil jr"), (lambda: parse.womens(F.lit("Women's Flyweight")), 1),
        (lambda: parse.partial_match(F.lit("lee"), F.lit("miles lee")), True), (lambda: parse.token_match(F.lit("lee"), F.lit("miles leeds")), False), (lambda: market.american_to_decimal(F.lit(170)), 2.7),
        (lambda: market.american_to_decimal(F.lit(-200)), 1.5), (lambda: staking.kelly_fraction(F.lit(0.6), F.lit(2.0)), pytest.approx(0.2)), (lambda: staking.risk_of_ruin(F.lit(0.5), F.lit(20), F.lit(20)), 0.5),
        (lambda: staking.beta_mean(F.lit(3), F.lit(1)), pytest.approx(4 / 6)),
    ],
)
def test_scalars(spark, expr, want):
    assert one(spark, expr()) == want


def test_american_text(spark):
    assert [one(spark, parse.to_int(F.lit(x))) for x in ("+170", "-200", "x")] == [170, -200, None]


@pytest.mark.parametrize("method", ["normalize", "power", "shin"])
def test_fair_probabilities_sum_to_one(spark, method):
    rows = spark.createDataFrame([(-150, 130), (-110, -110), (100, 120), (None, 120)], "open_red int, open_blue int").withColumn("bout_id", F.lit("x"))
    from ringside.operators.market import devig

    out = devig(rows, "open", method).collect()
    assert all(abs(r["fair_red_open"] + r["fair_blue_open"] - 1) < 1e-9 for r in out[:3])
    assert out[3]["fair_red_open"] is None


def test_history_matches_a_plain_loop(spark, view):
    rows = view.select("bout_id", "dt", "fighter_red", "fighter_blue", "winner").toPandas().sort_values(["dt", "bout_id"])
    state, want, beaten, lost = {}, {}, {}, {}
    for _, r in rows.iterrows():
        a, b = r.fighter_red, r.fighter_blue
        flag = lambda x, y: int(bool(beaten.get(x, set()) & lost.get(y, set())))
        want[r.bout_id] = (*state.get(a, (0, 0, 0, 0)), *state.get(b, (0, 0, 0, 0)), flag(a, b), flag(b, a))
        for me, other, won in ((a, b, r.winner == 1), (b, a, r.winner == 0)):
            n, w, ws, ls = state.get(me, (0, 0, 0, 0))
            draw = r.winner == 2
            state[me] = (n + 1, w + won, ws + 1 if won else 0, 0 if won or draw else ls + 1)
            if won:
                beaten.setdefault(me, set()).add(other)
                lost.setdefault(other, set()).add(me)
    got = history.streaks(view).join(history.common_opponents(view), "bout_id").collect()
    assert len(got) == len(rows)
    for r in got:
        red, blue = ((r[f"num_fights_{k}"], r[f"num_wins_{k}"], r[f"win_streak_{k}"], r[f"lose_streak_{k}"]) for k in ("red", "blue"))
        assert (*red, *blue, r["mma_math_red"], r["mma_math_blue"]) == want[r["bout_id"]]


def test_no_leakage(view):
    cut = dt.date(1995, 1, 1)
    early = {tuple(r) for r in history.totals_per_minute(view.filter(F.col("dt") < cut)).collect()}
    known = {r[0] for r in view.filter(F.col("dt") < cut).select("bout_id").collect()}
    assert {tuple(r) for r in history.totals_per_minute(view).collect() if r["bout_id"] in known} == early


def ordered(view):
    cols = view.select("moment", "bout_id", "fighter_red", "fighter_blue", "winner", "weight_class", "sig_str_red", "sig_str_blue")
    return cols.toPandas().sort_values("moment")


def strikes(text):
    return int(text.split(" of ")[0])


def test_elo_matches_a_plain_loop(view):
    """One table for all bouts, or one for each division."""
    for part in (None, "weight_class"):
        elo, want = {}, {}
        for _, r in ordered(view).iterrows():
            t = elo.setdefault(part and r.weight_class, {})
            a, b = t.get(r.fighter_red, 1500.0), t.get(r.fighter_blue, 1500.0)
            want[r.bout_id] = (a, b)
            if r.winner != 2:
                change = 32 * (r.winner - 1 / (1 + 10 ** ((b - a) / 400)))
                t[r.fighter_red], t[r.fighter_blue] = a + change, b - change
        got = rating.elo(view, part).collect()
        assert all((r["elo_red"], r["elo_blue"]) == pytest.approx(want[r["bout_id"]], abs=1e-9) for r in got) and len(got) == len(want)
        assert all(abs(sum(t.values()) - 1500 * len(t)) < 1e-6 for t in elo.values())


def plain_margin_elo(rows, k, factor, scale=400.0, cutoff=None, cutoff_scale=1.0, regress=0.0, every=0):
    """Ratings before each match, and all ratings after the last."""
    t, before = {}, []
    for n, (red, blue, won, w) in enumerate(rows, 1):
        a, b = t.get(red, 1500.0), t.get(blue, 1500.0)
        before.append((a, b))
        change = k * factor(w if w > 0 else 1.0) * (cutoff_scale if cutoff is not None and a >= cutoff and b >= cutoff else 1.0) * (won - 1 / (1 + 10 ** ((b - a) / scale)))
        t[red], t[blue] = a + change, b - change
        if every and n % every == 0:
            t = {f: x + regress * (1500 - x) for f, x in t.items()}
    return before, t


FACTORS = {"linear": lambda w: max(w - 1, 1), "log": lambda w: math.log(150 * max(w - 1, 0) + 1), "sqrt": lambda w: math.sqrt(100 * w)}


def played_rows(view):
    out = []
    for _, r in ordered(view).iterrows():
        a, b = strikes(r.sig_str_red), strikes(r.sig_str_blue)
        out.append((r.bout_id, r.fighter_red, r.fighter_blue, int(r.winner) if r.winner in (0, 1) else int(a > b), float(abs(a - b))))
    return out


@pytest.fixture(scope="module")
def played(view):
    return rating.matches(view, parse.landed(F.col("sig_str_red")), parse.landed(F.col("sig_str_blue")))


@pytest.mark.parametrize("kind", list(FACTORS))
def test_margin_elo_matches_a_plain_loop(view, played, kind):
    rows = played_rows(view)
    before, _ = plain_margin_elo([r[1:] for r in rows], 20.0, FACTORS[kind], cutoff=1600.0, cutoff_scale=0.5, regress=0.1, every=100)
    want = dict(zip([r[0] for r in rows], before, strict=True))
    got = rating.margin_elo(played, k=20.0, margin=kind, cutoff=1600.0, cutoff_k_scale=0.5, season=100, regress=0.1).collect()
    assert len(got) == len(want) and all((r["elo_red"], r["elo_blue"]) == pytest.approx(want[r["bout_id"]], abs=1e-6) for r in got)
    assert [rating.MARGINS[m](4.0) for m in ("none", "linear", "exp")] == [1.0, 3.0, 81.0]


def test_grid_search_freezes_ratings(spark, view, played):
    """Each fold is scored with the ratings that its training part left."""
    rows = [r[1:] for r in played_rows(view)]
    got = rating.grid_search(played, rating.grid(spark, base_k=[10.0, 30.0], w90=[None, 300.0], cutoff_rating=[1550.0], regress_to_mean=[0.1], regress_every=[500]), folds=4).collect()
    n = len(rows)
    first, window = int(0.2 * n), int(0.1 * n)
    cuts = [first + i * ((n - first - window) // 3) for i in range(4)]
    for r in got:
        scale = r["w90"] / math.log10(9) if r["w90"] else 400.0
        losses, briers = [], []
        for cut in cuts:
            _, t = plain_margin_elo(rows[:cut], r["base_k"], FACTORS["log"], scale, 1550.0, 1.0, 0.1, 500)
            p = [(min(max(1 / (1 + 10 ** ((t.get(b, 1500.0) - t.get(a, 1500.0)) / scale)), 1e-12), 1 - 1e-12), y) for a, b, y, _ in rows[cut : cut + window]]
            losses.append(sum(-math.log(q if y else 1 - q) for q, y in p) / len(p))
            briers.append(sum((q - y) ** 2 for q, y in p) / len(p))
        assert (r["logloss"], r["brier"]) == (pytest.approx(sum(losses) / 4, abs=1e-9), pytest.approx(sum(briers) / 4, abs=1e-9))
    assert len(got) == 4 and [r["logloss"] for r in got] == sorted(r["logloss"] for r in got)


def test_glicko_matches_a_plain_loop(view):
    q, state, want = 0.0057565, {}, {}
    for _, r in ordered(view).iterrows():
        a, b = state.get(r.fighter_red), state.get(r.fighter_blue)
        want[r.bout_id] = (*(a or (1500.0, 350.0)), *(b or (1500.0, 350.0)))
        new = []
        for me, other, won in ((a, b, r.winner == 1), (b, a, r.winner != 1)):
            rating_, rd = (me[0], min(math.sqrt(me[1] ** 2 + 34**2), 350.0)) if me else (1500.0, 350.0)
            r2, rd2 = other or (1500.0, 350.0)
            g = 1 / math.sqrt(1 + 3 * q * q * rd2 * rd2 / math.pi**2)
            e = 1 / (1 + 10 ** (-g * (rating_ - r2) / 400))
            d2 = 1 / (q * q * g * g * e * (1 - e))
            new.append((rating_ + q / (1 / rd**2 + 1 / d2) * g * (won - e), math.sqrt(1 / (1 / rd**2 + 1 / d2))))
        state[r.fighter_red], state[r.fighter_blue] = new
    got = rating.glicko(view).collect()
    assert len(got) == len(want) and all((r["r_red"], r["rd_red"], r["r_blue"], r["rd_blue"]) == pytest.approx(want[r["bout_id"]], abs=1e-6) for r in got)
    both = {r["bout_id"]: r for r in rating.elo_and_glicko(view).collect()}
    assert all((both[r["bout_id"]]["glicko_red"], both[r["bout_id"]]["glicko_rd_blue"]) == (r["r_red"], r["rd_blue"]) for r in got)


def test_glicko2_example():
    """One bout of the published example: 1500 (RD 200, volatility 0.06) against 1400 (RD 30)."""
    s = rating.GLICKO2_SCALE
    mu, phi, sigma = rating.Glicko2(tau=0.5).updated((0.0, 200 / s, 0.06), ((1400 - 1500) / s, 30 / s, 0.06), 1.0)
    assert 1500 + s * mu == pytest.approx(1563.56, abs=0.1) and s * phi == pytest.approx(175.4, abs=0.2) and sigma == pytest.approx(0.06, abs=1e-4)


def test_band_join_days_and_names(spark):
    day = dt.date(2024, 5, 4)
    stats = spark.createDataFrame([("b1", day, "Saint-Denis", "Zach Reese")], "bout_id string, dt date, fighter_red string, fighter_blue string")
    odds = spark.createDataFrame(
        [("ST Denis", "zach reese", day + dt.timedelta(days=k), k) for k in (-2, -1, 0, 1, 2)] + [("st denis", "zach reese", None, 9), ("st denis", "zach reese", day, 0)],
        "red_name string, blue_name string, odds_dt date, line int",
    )
    assert sorted(r["line"] for r in match.band_join(stats, odds).collect()) == [-1, 0, 1]
    assert match.band_join(stats, odds.limit(0)).collect()[0]["line"] is None


def test_audits(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("b", 1, "x")], "k string, v int, w string")
    assert {r["column_name"]: r["n_null"] for r in audit.null_profile(df).collect()} == {"k": 0, "v": 0, "w": 2}
    assert [tuple(r) for r in audit.differing_columns(df, ["k"]).collect()] == [("a", 2, "v")]
    assert audit.rows_with_duplicate_keys(df, ["k"]).count() == audit.marked_duplicates(df, ["k"]).count() == 2


def test_bankroll_floor(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, k + 1), r) for k, r in enumerate((0.5, -0.99, 1.0))], "dt date, ret double")
    got = [r["bankroll"] for r in bankroll.bankroll(days, start=100.0, floor=10.0, reset=50.0).orderBy("dt").collect()]
    assert got == [150.0, 50.0, 100.0]


def test_simultaneous_kelly_keeps_every_pick(view):
    """No pick of positive value is left out."""
    want = {r["bout_id"] for r in tables.choices(view).filter("choice_ev_close1 > 0").collect()}
    got = bankroll.simultaneous_kelly(view).collect()
    assert {r["bout_id"] for r in got} == want and len(got) == len(want) and all(r["stake"] >= 0 for r in got)


def test_bayesian_kelly(spark):
    """Against the closed form of its mean where every draw has an edge, and a portfolio by hand."""
    bets = spark.createDataFrame([("a", 80, 10, 2.0, dt.date(2024, 1, 1)), ("b", 60, 20, 2.5, dt.date(2024, 1, 1)), ("c", 1, 30, 1.5, dt.date(2024, 1, 2))], "bout_id string, right_count int, wrong_count int, odds double, dt date")
    got = {r["bout_id"]: r for r in bankroll.bayesian_kelly(bets).collect()}
    assert got["a"]["kelly_mean"] == pytest.approx(81 / 92 * 2 - 1, abs=3e-3) and got["b"]["kelly_mean"] == pytest.approx((61 / 82 * 2.5 - 1) / 1.5, abs=3e-3) and got["c"]["kelly_mean"] == 0
    rows = {r["bout_id"]: r for r in bankroll.portfolio_bayesian_kelly(bets, target=0.1).collect()}
    total = 0.0
    for k, p, o in (("a", 81 / 92, 2.0), ("b", 61 / 82, 2.5)):
        f = got[k]["kelly_mean"]
        win, lose = math.log(1 + f * (o - 1)), math.log(1 - f)
        mu = p * win + (1 - p) * lose
        sd = math.sqrt(p * (win - mu) ** 2 + (1 - p) * (lose - mu) ** 2)
        assert rows[k]["sigma"] == pytest.approx(sd)
        total += (f * sd) ** 2
    far = math.sqrt(2 * math.log(1000))
    assert rows["a"]["k"] == rows["b"]["k"] == pytest.approx(0.1 / (math.sqrt(total) * far)) and rows["c"]["k"] == 1 and rows["a"]["drawdown_scaled"] == pytest.approx(0.1)
    card = bets.filter("bout_id <> 'c'").withColumn("stake", F.lit(0.05))
    falls = [r["drawdown"] for r in bankroll.portfolio_drawdowns(card, trials=40, rounds=50).collect()]
    assert len(falls) == 40 and all(0 <= x < 1 for x in falls) and falls == [r["drawdown"] for r in bankroll.portfolio_drawdowns(card, trials=40, rounds=50).collect()]


def test_feature_table_holds_every_family(view):
    """The one table against the families one by one."""
    wide = {r["bout_id"]: r for r in history.feature_table(view).collect()}
    for family in (history.totals_per_minute, history.accuracy, history.defence, history.fight_time, history.months_since_last, history.streaks, history.method_wins, history.method_win_share, history.total_bonus, history.favourite_counts):
        rows = family(view).collect()
        assert len(rows) == len(wide) and all(wide[r["bout_id"]][n] == r[n] for r in rows for n in r.asDict()), family.__name__
    for name, stat in history.RATIOS.items():
        assert all(wide[r["bout_id"]][f"{name}_red"] == r[f"{name}_red"] for r in history.cumulative_ratio(view, stat, name).collect())


def test_power_margin_by_bisection(spark):
    """Newton's steps against halving, and the bound of 5 on the exponent."""
    lines = [(a, b) for a in (-900, -250, -110, 105, 300, 1500) for b in (-900, -150, 120, 400, 2500)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in lines], "open_red double, open_blue double")
    for r in tables.devig(df, "open", "power").collect():
        p, q = ((100 / abs(x) + 1 if x < 0 else x / 100 + 1) ** -1 for x in (r["open_red"], r["open_blue"]))
        low, high = 0.0, 5.0
        for _ in range(100):
            m = (low + high) / 2
            low, high = (m, high) if p**m + q**m > 1 else (low, m)
        assert r["fair_red_open"] == pytest.approx(p**low / (p**low + q**low), abs=1e-9)


def test_merge_and_look_up(spark):
    a = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "k int, n string, v int")
    b = spark.createDataFrame([(1, "x", 7), (1, "z", 8)], "k int, n string, v int")
    out = match.merge(a, b, ["k", "n"])
    assert out.columns == ["k", "n", "v_x", "v_y"] and [tuple(r) for r in out.collect()] == [(1, "x", 5, 7)]
    names = spark.createDataFrame([("x", "ex")], "key string, value string")
    assert sorted((r["n"], r["value"]) for r in match.look_up(a, names, "n", "n").collect()) == [("x", "ex"), ("y", "y")]


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, n string")
    src.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, src.read_csv(spark, str(tmp_path / "out"), df.schema).collect())) == [(1, "a,b"), (2, None)]


def test_mrmr_leaves_copies_for_later(spark):
    """The copy of the most telling feature comes after an independent one that tells less."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 4000)
    a, b = np.where(rng.random(4000) < 0.9, y, 1 - y), np.where(rng.random(4000) < 0.7, y, 1 - y)
    df = spark.createDataFrame([tuple(map(int, r)) for r in zip(y, a, a, b, strict=True)], "y int, a int, a2 int, b int")
    got = [r["feature"] for r in evaluation.mrmr(df, {n: F.col(n) for n in ("a", "a2", "b")}, "y", 3).orderBy("rank").collect()]
    assert got == ["a", "b", "a2"]
    flags = evaluation.with_mistakes(spark.createDataFrame([(1, 0, 0.9), (0, 1, 0.6), (1, 1, 0.8)], "g int, t int, p double"), "g", "t", "p").orderBy("p").collect()
    assert [(r["wrong"], r["false_positive"], r["false_negative"], r["sure_mistake"]) for r in flags] == [(1, 0, 1, 0), (0, 0, 0, 0), (1, 1, 0, 1)]


def test_simultaneous_stakes_single_bet_is_kelly():
    assert stakes.best_stakes([[0.6]], [[2.0]], cap=1.0)[0, 0] == pytest.approx(0.2, abs=1e-6)


@given(st.floats(0.5, 60), st.floats(0.5, 60), st.floats(0.01, 0.99))
def test_incomplete_beta_symmetry(a, b, x):
    assert evaluation.incomplete_beta(a, b, x) + evaluation.incomplete_beta(b, a, 1 - x) == pytest.approx(1, abs=1e-9)


def test_t_quantiles():
    assert evaluation.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert evaluation.t_above(1.812461, 10) == pytest.approx(0.05, abs=1e-6)
    assert math.isclose(evaluation.t_above(0.0, 5), 0.5)


def test_snapshots_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    src.write_snapshot(df, str(tmp_path / "s"), "2024-01-01")
    src.write_snapshot(df.limit(1), str(tmp_path / "s"), "2024-02-01")
    assert src.read_latest_snapshot(spark, str(tmp_path / "s")).count() == 1
    (tmp_path / "c.csv").write_text("title_fight,fighter_red,fighter_blue,weight_class,event_date,event_location,reach_red,reach_blue,height_red,height_blue,dob_red,dob_blue\n1,A,B,Fly,2024-01-01,X,,,,,,\n")
    assert src.read_csv(spark, str(tmp_path / "c.csv"), src.BOUTS_UPCOMING).head()["event_date"] == dt.date(2024, 1, 1)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th></tr><TR class='x'><td> <b>1</b> of 2</td><td>x</td></TR></table><a href='/n'>n</a>")], "page_id long, html string")
    assert [r["cells"] for r in src.fight_rows(pages).collect()] == [["a"], ["1 of 2", "x"]]
    assert src.links(pages).head()["href"] == "/n"


def test_streaming_records(spark, view, tmp_path):
    from ringside.streaming.history import prefight_records

    some = view.limit(300)
    some.select("bout_id", "dt", "fighter_red", "fighter_blue", "winner").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("bout_id string, dt date, fighter_red string, fighter_blue string, winner int").parquet(str(tmp_path / "in"))
    q = prefight_records(stream).writeStream.format("memory").queryName("records").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("records").count() == 600


SAMPLE = ("build_features", "elo_mov", "glicko", "simulate_kelly_history", "simulate_kelly_parlay", "pairwise_information", "scan_filter_project", "differing_columns", "prefight_core", "accuracy", "fight_time", "ratio_td", "devig_shin", "band_join_odds", "auc_ranksum", "graph_edges", "parlay_topn")


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = plans.queries()[name](spark, SMALL)
    rel = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(key, rel.fetchall()))


def test_nearest_bouts_in_many_blocks(spark, monkeypatch):
    """All held-out bouts, ties, and cohorts, against all distances."""
    rng = np.random.default_rng(3)
    n, day = 1500, 500
    z = rng.integers(0, 12, (n, 2)).astype(float)
    moved = [(-100, -110), (-100, 120), (150, 130)]
    rows = [(f"b{k:05d}", k >= day, [float(v) for v in z[k]], *moved[k % 3]) for k in range(n)]
    b = spark.createDataFrame(rows, "bout_id string, is_train boolean, v array<double>, choice_open int, choice_close1 int")
    monkeypatch.setattr(learn, "training_frame", lambda x: x)
    monkeypatch.setattr(learn, "choices", lambda x: x)
    monkeypatch.setattr(learn, "scaled", lambda x, k: (None, x.select("bout_id", "is_train", array_to_vector("v").alias("pca"))))
    got = {}
    for r in learn.nearest_bouts(b, block=100, chunk=70).collect():
        got.setdefault((r["bout_id"], r["cohort"]), {})[r["rank"]] = r["near_id"]
    past = np.arange(day, n)
    for name, some in (("entire_history", past), ("stayed_fav", past[past % 3 == 0]), ("fav_to_dog", past[past % 3 == 1]), ("stayed_dog", past[past % 3 == 2])):
        d = ((z[:day, None, :] - z[None, some, :]) ** 2).sum(axis=2)
        near = some[np.argsort(d, axis=1, kind="stable")[:, :5]]
        assert all(got[f"b{k:05d}", name] == {j + 1: f"b{near[k, j]:05d}" for j in range(5)} for k in range(day)), name
