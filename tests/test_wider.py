"""Odds pages, names, neighbours, incremental features and stakes against plain versions."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringside.functions import parse, staking
from ringside.operators import attention, audit, bankroll, forest, history, incremental, learn, market, match, names, neighbours, penalised, stakes, tables, towers
from ringside.plans import wider
from ringside.sources import bouts as src
from ringside.sources import odds_pages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def view(spark):
    return src.bouts_view(spark, SF).persist()


def cell(*prices):
    return "".join(f'<td class="moneyline"><span>{x}</span></td>' for x in prices)


def head(name):
    return f'<th class="oppcell x"><a href="/f">{name}</a></th>'


PAGES = {
    "whole": f"<table><TR CLASS='main-row even'>{head('José &amp; Co')}{cell('+170', '-200', '+100')}</TR><tr>{head('Bo-Ann Lee')}{cell('-150', '+1', '-99')}<td class=item-non-mobile>May 4, 2024</td></tr></table>",
    "two": f"<table><tr class=main-row>{head('A')}{cell(1, 2, 3)}</tr><tr>{head('B')}{cell(4, 5, 6)}</tr><tr><td>ad</td></tr><tr class='main-row'>{head('C')}{cell(7, 8, 9)}</tr><tr>{head('D')}{cell(-1, -2, -3)}<td class='item-non-mobile'>soon</td></tr></table>",
    "no end tags": f"<table><tr class=main-row>{head('A')}<td class=moneyline><span>+5<td class=moneyline><span>6<td class=moneyline><span>n/a<tr>{head('B')}{cell(1, 2, 3)}",
    "cut off": f"<table><tr class='main-row'>{head('A')}{cell(1)}</tr></table><table><tr>{head('other table')}</tr></table>",
    "hidden": "<!-- <tr class='main-row'>--><script>var x = \"<tr class='main-row'>\"</script><p class='main-row'>main-row</p>",
    "garbage": "main-row <tr <<< class='main-row' > &#xZZ; <th class='oppcell'>",
    "empty": "",
    "missing": None,
}


def test_pairs_of_odd_pages(spark):
    df = spark.createDataFrame([(k, v, 1) for k, v in PAGES.items()], "url string, html string, pair_id int")
    got = {}
    for r in odds_pages.odds_rows(df).orderBy("pair").collect():
        got.setdefault(r["url"], []).append(tuple(r)[2:])
    assert got["whole"] == [(0, "José & Co", "Bo-Ann Lee", 170, -200, 100, -150, 1, -99, dt.date(2024, 5, 4), True)]
    assert got["two"] == [(0, "A", "B", 1, 2, 3, 4, 5, 6, None, True), (1, "C", "D", 7, 8, 9, -1, -2, -3, None, True)]
    assert got["no end tags"] == [(0, "A", "B", 5, 6, None, 1, 2, 3, None, True)]
    assert got["cut off"] == [(0, "A", None, 1, None, None, None, None, None, None, False)]
    assert "hidden" not in got and set(got["garbage"][0][1:]) == {None, False} and not {"empty", "missing"} & set(got)
    assert odds_pages.odds_rows(df.limit(0)).count() == 0


def test_wanted_odds(spark):
    pages = spark.createDataFrame([("u", PAGES["whole"].replace("José &amp; Co", "jose st. clair")), ("v", PAGES["two"])], "url string, html string")
    work = spark.createDataFrame([("Jose Clair", ["Ann Lee", "Lee", "Zed"]), ("A", ["X"]), ("Nobody", ["Lee"])], "fighter_red string, opponents array<string>")
    got = odds_pages.wanted_odds(pages, work).collect()
    assert [(r["red_name"], r["blue_name"], r["og_red_fighter"], r["og_blue_name"], r["close1_blue"]) for r in got] == [("jose st. clair", "Bo-Ann Lee", "Jose Clair", "Ann Lee", 1)]


def test_names_equal_all_pairs(spark):
    """Names that share endings, one very common word, accents, empty and missing names; few pairs are looked at."""
    rng = random.Random(4)
    parts = ["ann", "lee", "van", "der", "berg", "o'neil", "saint", "st", "zé", "al", "alan", "alana", "silva", "li"]
    make = lambda: [rng.choice([" ", "-"]).join(rng.sample(parts, rng.randint(1, 3))).title() for _ in range(150)] + ["", None, "Silva"]
    a, b = make(), make()
    left, right = (spark.createDataFrame([(x,) for x in v], f"{k} string") for k, v in (("a", a), ("b", b)))
    got = {tuple(r) for r in names.resolve(left, right, "a", "b").collect()}
    pairs = left.distinct().crossJoin(right.distinct()).filter("a <> '' and b <> ''")
    assert got == {tuple(r) for r in pairs.filter(parse.token_match(F.col("a"), F.col("b"))).collect()}
    spelt = spark.createDataFrame([("Zachary Reese",), ("Jon Jones",)], "a string"), spark.createDataFrame([("Zachari Reese",), ("John Jones",), ("Jo Smith",)], "b string")
    assert {tuple(r) for r in names.resolve(*spelt, "a", "b", share=0.6).collect()} == {("Zachary Reese", "Zachari Reese"), ("Jon Jones", "John Jones")}
    assert names.resolve(*spelt, "a", "b").count() == 0


def test_few_candidates_for_many_names(spark, monkeypatch):
    """The index looks at far fewer pairs than all: at most ten times the names."""
    n = 3000
    one = spark.range(n).select(wider.full_name(F.concat(F.lit("F"), "id")).alias("a"))
    two = spark.range(n).select(wider.page_name(F.concat(F.lit("F"), "id")).alias("b"))
    met = []
    real = names._contained
    monkeypatch.setattr(names, "_contained", lambda *x: met.append(real(*x)) or met[-1])
    assert names.resolve(one, two, "a", "b").count() == n
    assert sum(m.count() for m in met) <= 10 * 2 * n


@pytest.mark.parametrize(("n", "dims", "k"), [(3000, 3, 5), (900, 1, 7), (4, 2, 5)])
def test_exact_nearest(spark, n, dims, k):
    """Ties, one crowded place, parts of their own, small blocks; against all distances."""
    rng = np.random.default_rng(n)
    z = rng.integers(0, 9, (n, dims)).astype(float)
    z[: n // 3] = 4
    q = np.vstack([rng.integers(-3, 12, (120, dims)), np.full((30, dims), 4)]).astype(float)
    part = np.where(np.arange(n) % 4 == 0, "x", "y")
    history_ = spark.createDataFrame([(f"h{i:05d}", [float(v) for v in z[i]], str(part[i])) for i in range(n)], "id string, z array<double>, part string")
    asked = spark.createDataFrame([(f"q{i:03d}", [float(v) for v in q[i]], p) for i in range(150) for p in ("x", "y", "none")], history_.schema)
    got = {}
    for r in neighbours.exact_nearest(history_, asked, k, block=20, chunk=64).collect():
        got.setdefault((r["id"], r["part"]), {})[r["rank"]] = (r["near_id"], r["distance"])
    for p in ("x", "y"):
        some = np.flatnonzero(part == p)
        d = np.sqrt(((q[:, None, :] - z[None, some, :]) ** 2).sum(axis=2))
        for i in range(150):
            near = np.argsort(d[i], kind="stable")[:k]
            assert got[f"q{i:03d}", p] == {j + 1: (f"h{some[x]:05d}", d[i, x]) for j, x in enumerate(near)}
    assert {p for _, p in got} == {"x", "y"}
    assert neighbours.exact_nearest(history_.limit(0), asked).count() == 0 and neighbours.exact_nearest(history_, asked.limit(0)).count() == 0


def test_incremental_features_equal_the_full_build(spark, view, tmp_path):
    """In three portions, with the state written between them, and no old bouts in the last plan."""
    days = [r["dt"] for r in view.select("dt").distinct().orderBy("dt").collect()]
    cuts = [days[0], days[len(days) // 2], days[-20], days[-1] + dt.timedelta(days=1)]
    state, got = None, []
    for k, (a, b) in enumerate(itertools.pairwise(cuts)):
        view.filter(F.col("dt").between(a, b - dt.timedelta(days=1))).write.parquet(f"{tmp_path}/bouts{k}")
        new = spark.read.parquet(f"{tmp_path}/bouts{k}")
        wide = incremental.features_after(new, state)
        got += wide.collect()
        assert all(f"bouts{k}" in f or f"state{k - 1}" in f for f in wide.inputFiles())
        incremental.state_after(new, state).write.parquet(f"{tmp_path}/state{k}")
        state = spark.read.parquet(f"{tmp_path}/state{k}")
    want = history.feature_table(view)
    assert set(wide.columns) == set(want.columns)
    assert {r["bout_id"]: r.asDict() for r in got} == {r["bout_id"]: r.asDict() for r in want.collect()}
    fighters = view.select(F.explode(F.array("fighter_red", "fighter_blue")).alias("f")).groupBy("f").count().collect()
    assert {r["fighter"]: r["n"] for r in state.collect()} == {r["f"]: r["count"] for r in fighters}


def enumerated(p, odds, f):
    """Expected log wealth over all joint outcomes."""
    r, m = p.shape
    chance, wealth = np.ones(1), np.full(1, 1 - f.sum())
    for i in range(r):
        each = np.append(p[i], max(0.0, 1 - p[i].sum()))
        pays = np.append(odds[i] * f[i], 0.0)
        chance, wealth = np.multiply.outer(chance, each).ravel(), np.add.outer(wealth, pays).ravel()
    some = chance > 1e-15
    return float(chance[some] @ np.log(wealth[some]))


@pytest.mark.parametrize(("r", "m", "cap", "sure"), [(1, 1, 1.0, False), (3, 2, 0.15, True), (12, 1, 0.15, False), (8, 2, 0.15, True), (5, 3, 0.05, False)])
def test_stakes_against_enumeration(r, m, cap, sure):
    rng = np.random.default_rng(10 * r + m)
    p = rng.dirichlet(np.ones(m + 1) * 3, r)[:, :m]
    p = p / p.sum(axis=1, keepdims=True) if sure else p
    odds = rng.uniform(0.95, 1.25, (r, m)) / p
    f = rng.uniform(0, 0.5 / (r * m), (r, m))
    value, slope, blocks, factor = stakes.log_growth(p, odds, f)
    assert value == pytest.approx(enumerated(p, odds, f), abs=1e-9)
    curve = factor.T @ factor
    for i, j, k in itertools.product(range(r), range(m), range(m)):
        curve[i * m + j, i * m + k] += blocks[i, j, k]
    for b in range(min(4, r * m)):
        e = np.zeros(r * m)
        e[b] = 1e-5
        up, down = (stakes.log_growth(p, odds, f + s * e.reshape(r, m)) for s in (1, -1))
        assert slope.ravel()[b] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-6)
        assert -curve[b] == pytest.approx((up[1] - down[1]).ravel() / 2e-5, abs=1e-4)
    best = stakes.best_stakes(p, odds, cap)
    assert (best >= 0).all() and best.max() <= cap and best.sum() <= 1 and (best == stakes.best_stakes(p, odds, cap)).all()
    top = enumerated(p, odds, best)
    g = stakes.log_growth(p, odds, best)[1]  # no feasible direction gains: the best corner of the bounds
    order = np.argsort(-g.ravel())
    corner, left = np.zeros(r * m), 1.0
    for b in order[g.ravel()[order] > 0]:
        corner[b] = min(cap, left)
        left -= corner[b]
    assert float(g.ravel() @ (corner - best.ravel())) < 1e-6 and top >= enumerated(p, odds, f * (f < cap)) - 1e-9


def test_both_ways_of_a_newton_step():
    rng = np.random.default_rng(5)
    blocks = np.stack([x @ x.T + np.eye(2) for x in rng.normal(size=(6, 2, 2))])
    g = rng.normal(size=(6, 2))
    factor = rng.normal(size=(4, 12))
    low = stakes._newton_step(blocks, factor, g)
    high = stakes._newton_step(blocks, np.vstack([factor, np.zeros((20, 12))]), g)
    assert low == pytest.approx(high)


def test_exclusive_stakes_of_a_day(view):
    from ringside.operators import bankroll

    some = view.filter(F.col("dt") < dt.date(1995, 4, 1))
    got = bankroll.exclusive_kelly(some).collect()
    assert len(got) == some.count() and all(0 <= r[k] <= 0.15 for r in got for k in ("stake_red", "stake_blue"))
    by_day = {}
    for r in got:
        by_day[r["dt"]] = by_day.get(r["dt"], 0) + r["stake_red"] + r["stake_blue"]
    assert max(by_day.values()) <= 1


def logistic_rows(spark, n=1200, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.array([1.0, -0.5, 0.05, 0.0])[:d] + 0.3)))).astype(int)
    rows = spark.createDataFrame([(f"b{k:05d}", [float(v) for v in x[k]], int(y[k])) for k in range(n)], "bout_id string, x array<double>, y int")
    return rows.repartition(6), x, y


def test_path_equals_separate_fits(spark):
    """Every strength against a fit of its own, in at most 20 scans for all of them."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows, *_ = logistic_rows(spark)
    pairs = [(s, e) for s in (1e-4, 1e-3, 0.01, 0.05, 0.1, 0.3) for e in (1.0, 0.5, 0.0)]
    beta, scans = penalised.fit_many(rows.withColumn("fold", F.lit(-2)), [penalised.Setting(s * e, s * (1 - e)) for s, e in pairs], 4)
    assert scans <= 20
    ready = rows.select(array_to_vector("x").alias("v"), "y").persist()
    for (s, e), own in zip(pairs, beta, strict=True):
        fit = LogisticRegression(featuresCol="v", labelCol="y", regParam=s, elasticNetParam=e, tol=1e-10, maxIter=300).fit(ready)
        assert own == pytest.approx([*fit.coefficients, fit.intercept], abs=1e-3)
    assert (np.diff((beta[::3, :4] != 0).sum(axis=1)) <= 0).all() and not beta[15, :4].any()


def test_folds_and_macro_f1(spark):
    rows, x, y = logistic_rows(spark, n=503)
    dealt = penalised.stratified_folds(rows, 7)
    got = {r["bout_id"]: r["fold"] for r in dealt.collect()}
    assert dealt.columns == [*rows.columns, "fold"] and len(got) == 503
    fold = np.array([got[f"b{k:05d}"] for k in range(503)])
    for label in (0, 1):
        sizes = np.bincount(fold[y == label], minlength=7)
        assert sizes.max() - sizes.min() <= 1
    settings = [penalised.Setting(0.01, 0.01, f) for f in range(7)]
    beta, _ = penalised.fit_many(dealt, settings, 4)
    scores = penalised.macro_f1(dealt, settings, beta)
    for f in range(7):
        alone, _ = penalised.fit_many(dealt.filter(F.col("fold") != f), [penalised.Setting(0.01, 0.01)], 4)
        assert beta[f] == pytest.approx(alone[0], abs=1e-6)
        said, true = x[fold == f] @ beta[f][:4] + beta[f][4] > 0, y[fold == f] == 1
        f1 = [2 * (a & b).sum() / (a.sum() + b.sum()) for a, b in ((said, true), (~said, ~true))]
        assert scores[f] == pytest.approx(sum(f1) / 2)


def test_search_is_reproducible_and_turns_to_good_settings(spark):
    rows, *_ = logistic_rows(spark, n=400)
    dealt = penalised.stratified_folds(rows, 3).persist()
    got = penalised.parzen_search(dealt, 4, trials=12, folds=3, batch=4)
    assert np.allclose(got, penalised.parzen_search(dealt, 4, trials=12, folds=3, batch=4)) and len({r[1:3] for r in got}) == 12
    rng = np.random.default_rng(1)
    tried, score = np.zeros((0, 2)), lambda p: -((p - np.array([0.3, 0.8])) ** 2).sum(axis=1)
    for _ in range(8):
        tried = np.vstack([tried, penalised.propose(tried, score(tried), 6, rng)])
    assert score(tried[-12:]).mean() > score(tried[:6]).mean() and score(tried).max() > -0.01


def test_isolation_forest_equals_a_plain_walk(spark):
    """Scores over the same trees by plain loops; rows far out are found; trees don't depend on how rows lie."""
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(600, 3)), rng.normal(size=(12, 3)) * 0.3 + 8])
    rows = spark.createDataFrame([(f"b{k:04d}", [float(v) for v in x[k]]) for k in range(len(x))], "id string, x array<double>")
    fitted = forest.isolation_trees(rows, trees=40, sample=128)
    trees = fitted.orderBy("tree").collect()
    assert trees == forest.isolation_trees(rows.repartition(7), trees=40, sample=128).orderBy("tree").collect() and len(trees) == 40
    got = {r["id"]: r["score"] for r in forest.isolation_scores(rows, fitted, sample=128).collect()}
    for k in range(0, len(x), 7):
        total = 0.0
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] if x[k, t["feature"][at]] < t["cut"][at] else t["right"][at]
            total += t["length"][at]
        assert got[f"b{k:04d}"] == pytest.approx(2 ** (-total / 40 / forest.usual_length(128)))
    out = forest.without_outliers(rows, contamination=0.02, trees=40, sample=128).filter("outlier").collect()
    assert {r["id"] for r in out} >= {f"b{k:04d}" for k in range(600, 612)} and len(out) <= 14
    flat = spark.createDataFrame([(str(k), [1.0, 1.0]) for k in range(5)], "id string, x array<double>")
    assert {r["outlier"] for r in forest.without_outliers(flat).collect()} == {False}


def test_towers_gradient_and_fit(spark):
    """The gradient against finite differences; corners are interchangeable; a curved rating is learned that a straight one
    can't tell."""
    rng = np.random.default_rng(8)
    net = towers.Towers(3, 4)
    w = rng.normal(size=net.size) * 0.3
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 2, 40)
    got = net.loss_and_gradient(w, x, y)
    for k in range(net.size):
        e = np.zeros(net.size)
        e[k] = 1e-6
        assert got[1 + k] == pytest.approx((net.loss_and_gradient(w + e, x, y)[0] - net.loss_and_gradient(w - e, x, y)[0]) / 2e-6, abs=1e-4)
    swapped = np.hstack([x[:, 3:], x[:, :3]])
    assert net.logit(w, swapped) - w[-1] == pytest.approx(-(net.logit(w, x) - w[-1])) and got[-1] == 40
    x = rng.uniform(-2, 2, size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-4 * (np.abs(x[:, 0]) - np.abs(x[:, 1]))))).astype(int)
    rows = spark.createDataFrame([([float(v) for v in a], int(b), 0) for a, b in zip(x, y, strict=True)], "x array<double>, y int, fold int").repartition(4).persist()
    net, w = towers.fit_towers(rows, 1, hidden=6, steps=40)
    loss = lambda p: -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    p = np.array([r["p"] for r in towers.rated(rows.select("x"), net, w).collect()])
    seen = np.array([r["x"] for r in rows.select("x").collect()])
    assert p == pytest.approx(1 / (1 + np.exp(-net.logit(w, seen))))
    beta, _ = penalised.fit_many(rows, [penalised.Setting(0.0, 1e-3, -1)], 2)
    own = 1 / (1 + np.exp(-net.logit(w, x)))
    straight = 1 / (1 + np.exp(-(x @ beta[0][:2] + beta[0][2])))
    assert loss(own) < 0.8 * loss(straight)


def test_attention_round_equals_a_plain_loop(spark):
    """A hub that most edges end and start at, parallel edges, loops, a node without edges, an end that is no node; the number
    of salts changes nothing."""
    rng = np.random.default_rng(4)
    n, head = 40, attention.Head.drawn(3, 2, 7)
    x = rng.normal(size=(n, 3)) * 3
    edges = [(0, int(k)) for k in rng.integers(1, n - 1, 60)] + [(int(k), 0) for k in rng.integers(1, n - 1, 60)] + [(int(a), int(b)) for a, b in rng.integers(0, n - 1, (50, 2))] + [(3, 4), (3, 4), (5, 5), (999, 1), (1, 999)]
    w, s, t = np.array(head.weights), np.array(head.source), np.array(head.target)
    z = x @ w.T
    want = []
    for i in range(n):
        near = [a for a, b in edges if b == i and a < n] + [i]
        e = np.array([z[a] @ s + z[i] @ t for a in near])
        e = np.exp(np.where(e < 0, 0.2 * e, e))
        v = (e / e.sum()) @ z[near]
        want.append(np.where(v < 0, np.exp(v) - 1, v))
    nodes = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(n)], "id int, x array<double>")
    joined = spark.createDataFrame(edges, "src int, dst int")
    for salts in (1, 5):
        got = {r["id"]: r["x"] for r in attention.attention_round(nodes, joined, head, salts).collect()}
        assert set(got) == set(range(n)) and all(got[k] == pytest.approx(want[k]) for k in range(n))


def test_names_of_the_same_grams_do_not_meet(spark, monkeypatch):
    """Whole words are the index where whole words have to fit: names of the same q-grams but other words are no candidates."""
    n = 60
    one, two = (spark.range(2, n + 2).select(F.lit(1).alias("day"), F.expr("repeat('ab', cast(id as int))").alias(x)) for x in "ab")
    met = []
    real = names._contained
    monkeypatch.setattr(names, "_contained", lambda *x: met.append(real(*x)) or met[-1])
    assert names.resolve(one, two, "a", "b", by=["day"]).count() == n
    assert sum(m.count() for m in met) <= 2 * n


@pytest.mark.parametrize(("m", "cap"), [(1, 1.0), (2, 0.15), (1, 0.02)])
def test_stakes_of_a_crowded_day_are_those_of_its_best_bets(m, cap, monkeypatch):
    """Few events are solved at a time, and the stakes are the optimum over all of them."""
    rng = np.random.default_rng(m)
    p = np.round(0.05 + 0.009 * rng.integers(0, 100, 900), 3)[:, None]
    p = np.hstack([p, 1 - p])[:, :m]
    odds = rng.integers(105, 260, (900, m)) / 100
    asked = []
    real = stakes._interior
    monkeypatch.setattr(stakes, "_interior", lambda *x: asked.append(len(x[0])) or real(*x))
    got = stakes.best_stakes(p, odds, cap)
    assert max(asked) < 900 and got.sum() <= 1 and got.max() <= cap
    whole = real(p, odds, cap)
    assert stakes.expected_log(p, odds, got) >= stakes.expected_log(p, odds, whole) - 1e-8
    g = stakes.log_growth(p, odds, got)[1].ravel()
    corner, left = np.zeros(got.size), 1.0
    for b in np.argsort(-g):
        if g[b] > 0:
            corner[b] = min(cap, left)
            left -= corner[b]
    assert float(g @ (corner - got.ravel())) < 1e-4


def test_names_of_a_card_equal_all_pairs(spark):
    """Both rules against a look at every pair, with empty, missing and repeated names and other columns."""
    rng = random.Random(9)
    make = lambda k: [(rng.choice(["x", "y", None]), rng.choice(["", None, " Lee", "lee", "Al-Lee", "lee al", "aal", "eel", ".", "Zé Lee"]), i) for i in range(60)]
    left, right = spark.createDataFrame(make("a"), "card string, a string, m int"), spark.createDataFrame(make("b"), "card string, b string, n int")
    for tokens, rule in ((True, parse.token_match), (False, parse.partial_match)):
        got = match.match_names(left, right, "card", "a", "b", tokens)
        want = left.join(right, "card").filter(rule(F.col("a"), F.col("b")))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 50
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "card" in plan and not [x for x in plan.splitlines() if "Join Inner" in x and "card" in x and "array_except" in x]


def test_split_shuffles_only_the_day_of_the_cut(spark):
    """The cut by dt and bout_id, for shares of nothing and of all; no window over all bouts."""
    rng = random.Random(2)
    rows = [(f"b{i:03d}", dt.date(2024, 1, 1 + rng.randrange(5)), i) for i in range(200)]
    df = spark.createDataFrame(rows, "bout_id string, dt date, v int")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    for share in (0.0, 0.013, 0.5, 0.85, 1.0):
        got = audit.chronological_split(df, share)
        assert got.columns == ["bout_id", "dt", "v", "is_train"] and {r["bout_id"] for r in got.filter("is_train").collect()} == set(order[: int(200 * share)]) and got.count() == 200
    assert audit.chronological_split(df.limit(0)).count() == 0
    big = [x for x in audit.chronological_split(df)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "bout_id" in x]
    assert big and all("v#" not in x for x in big)


def test_differing_columns_without_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "b", None), (2, "a", 1), (2, "a", 2), (2, None, 2), (3, "a", 1), (4, "a", None), (4, "a", 3)], "k int, s string, v int")
    got = audit.differing_columns(df, ["k"])
    assert {tuple(r) for r in got.collect()} == {(1, 2, "s"), (2, 3, "v")}
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_exact_quantile(spark):
    """As F.percentile has it, with ties, NULLs and few rows; no aggregate holds all values in one task."""
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=5003).tolist(), rng.integers(0, 6, 999).astype(float).tolist() + [None] * 5, [3.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        for q in (0.0, 0.05, 0.5, 0.95, 0.985, 1.0):
            assert tables.quantile(df, "v", q) == pytest.approx(df.agg(F.percentile("v", q)).first()[0], rel=1e-12), q
    assert tables.quantile(df.limit(0), "v", 0.5) is None
    out = forest.without_outliers(spark.createDataFrame([(str(k), [float(k % 7), 0.5]) for k in range(300)], "id string, x array<double>"), trees=5)
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 300


def test_attention_sends_nodes_to_the_edges(spark):
    """Edges lie still where nodes are few; both ways give the same."""
    rng = random.Random(3)
    nodes = spark.createDataFrame([(f"n{i}", [rng.random() for _ in range(3)]) for i in range(30)], "id string, x array<double>")
    edges = spark.createDataFrame([(f"n{rng.randrange(33)}", f"n{rng.randrange(30)}") for _ in range(400)], "src string, dst string")
    head = attention.Head.drawn(3, 2, 4)
    sent, dealt = attention.attention_round(nodes, edges, head), attention.attention_round(nodes, edges, head, small=0)
    want = {r["id"]: r["x"] for r in dealt.collect()}
    got = {r["id"]: r["x"] for r in sent.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "by_src" not in sent._jdf.queryExecution().optimizedPlan().toString()


def test_rates_are_not_sent(view):
    """Totals per minute: what is dealt by bout are totals and seconds; the values are those of the feature table."""
    got = history.totals_per_minute(view)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.splitlines() if "RepartitionByExpression" in x or "Aggregate [bout_id" in x]
    assert dealt and all("_pm" not in x for x in dealt)
    want = history.one_family(history.told(view, history.STATS, ("fight_seconds",)), history.total_columns(), diff=True)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_two_towers_compute_their_frame_once(view, monkeypatch):
    """The scale, the fit and the ratings read one kept frame."""
    from ringside.operators import learn

    seen = []

    def fit(rows, width, hidden, steps):
        seen.append(rows)
        net = towers.Towers(width, hidden)
        return net, net.start()

    monkeypatch.setattr(learn, "fit_towers", fit)
    got = learn.two_towers(view)
    assert all("InMemoryRelation" in x._jdf.queryExecution().optimizedPlan().toString() and "Window" not in x._jdf.queryExecution().optimizedPlan().toString().split("InMemoryRelation")[0] for x in (got, seen[0]))
    assert 0 < got.count() < seen[0].count() and not [r for r in got.collect() if not 0 <= r["p"] <= 1]


def test_a_posterior_is_drawn_once(spark):
    """Rows that share counts and odds share their draws; each against its draws one by one, with few edges, all edges and none."""
    rows = [(f"b{i}", r, w, o) for i, (r, w, o) in enumerate([(30, 30, 2.0), (30, 30, 2.0), (30, 30, 1.6), (30, 30, 9.0), (30, 30, 1.0), (0, 0, 1.5), (30, 30, None)])]
    bets = spark.createDataFrame(rows, "bout_id string, right_count int, wrong_count int, odds double")
    got = {r["bout_id"]: r for r in bankroll.bayesian_kelly(bets, draws=500).collect()}
    assert len(got) == len(rows) and got["b0"][1:] == got["b1"][1:] and got["b6"]["kelly_mean"] is None
    for key, right, wrong, odds in rows[:4] + rows[5:6]:
        f = np.maximum((np.random.default_rng([7, right, wrong]).beta(1 + right, 1 + wrong, 500) * odds - 1) / (odds - 1), 0)
        assert tuple(got[key][1:]) == pytest.approx((f.mean(), f.std(ddof=1)), rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("most", [12_000_000, 20])
def test_common_opponents_in_blocks(spark, most):
    """Against a plain loop, with names, days and results that are null; wins are not joined with wins."""
    rnd = random.Random(9)
    day = lambda i: None if i % 41 == 0 else dt.date(1969, 12, 25) + dt.timedelta(i // 12)
    rows = [(f"{i:04}", day(i), None if i % 37 == 0 else f"F{rnd.randrange(30)}", f"F{rnd.randrange(30, 45) if i % 2 else rnd.randrange(30)}", rnd.choice([0, 1, 2, None])) for i in range(300)]
    b = spark.createDataFrame(rows, "bout_id string, dt date, fighter_red string, fighter_blue string, winner int")
    got = {r["bout_id"]: (r["mma_math_red"], r["mma_math_blue"]) for r in history.common_opponents(b, blocks=3, most=most).collect()}
    beaten, want = {}, {}
    order = lambda r: (r[1] is not None, r[1] or dt.date.min, r[0])
    for key, when, red, blue, won in sorted(rows, key=order):
        through = lambda a, z: any(
            z in beaten.get(m, {}) and (beaten[a][m] or beaten[m][z]) for m in beaten.get(a, {}))
        if when is None or red is None:
            want[key] = (0, 0)
        else:
            want[key] = (int(through(red, blue)), int(through(blue, red)))
        if red is not None and won in (0, 1):
            a, z = (red, blue) if won else (blue, red)
            of = beaten.setdefault(a, {})
            of[z] = of.get(z) or when is not None
    assert got == want and {(1, 0), (0, 1)} <= set(got.values())


def test_draws_are_told_without_numbers(spark):
    """Digests before a limit are those whose number is less than p, at the edges too; a run makes no number of a digest."""
    keys = spark.range(300).select(F.col("id").cast("string").alias("k")).withColumn("u", staking.uniform(F.col("k")))
    at = [0.0, -1.0, 1.0, 2.0, 0.5, 1 - 1e-13, 1e-12, 0.0003]
    p = F.explode(F.array(*map(F.lit, at), F.col("u"), F.col("u") + 2.0**-33, F.lit(None))).alias("p")
    told = keys.select("k", "u", p).withColumns({"want": F.col("u") < F.col("p"), "got": staking.draw(F.col("k")) < staking.limit(F.col("p"))})
    assert told.filter("not (want <=> got)").count() == 0 and told.filter("want").count() > 600
    b = src.bouts_view(spark, "/root/testdata/sf0.001")
    assert "conv(" not in bankroll.monte_carlo_units(b, 3)._jdf.queryExecution().toString()


def test_clusters_are_fitted_on_distinct_points(spark, monkeypatch):
    """Fits scan places with weights, not rows; and sums count every row."""
    b = src.bouts_view(spark, "/root/testdata/sf0.001")
    seen = []
    real = learn._points
    monkeypatch.setattr(learn, "_points", lambda *x, **y: seen.append(real(*x, **y)) or seen[-1])
    picks = market.choices(b).persist()
    n, units, right = picks.count(), picks.agg(F.sum("net_close1")).first()[0], picks.agg(F.sum("correct")).first()[0]
    done = learn.cluster_units(b, 4).collect()
    assert sum(r["n"] for r in done) == n and sum(r["units"] for r in done) == pytest.approx(units) and sum(r["accuracy"] * r["n"] for r in done) == pytest.approx(right)
    assert seen[0].count() == picks.select("choice_dec_open", "choice_dec_close1", "choice_prob").distinct().count() < n
    x = np.array([r["x"].toArray() for r in seen[0].collect()])
    w = np.array([r["weight"] for r in seen[0].collect()])
    assert np.allclose(w @ x, 0, atol=1e-6) and np.allclose(w @ x**2, n - 1)
    odds = learn.cluster_odds(b, 4).collect()
    assert sum(r["n"] for r in odds) == n and sum(r["n"] * r["mean_units"] for r in odds) == pytest.approx(units)


def test_cells_do_not_grow_with_the_rows(spark):
    """Twice the rows are twice the cells; and a group looks at few of its rows."""
    rng = np.random.default_rng(2)
    for n in (20_000, 40_000):
        z = rng.normal(size=(n, 3))
        sizes = np.bincount(neighbours.Splits(z[:: n // 1000], n // 500).leaf(z))
        assert len(sizes) == n // 500 and sizes.max() < 6 * 500
    seen = []
    real = neighbours._squares
    try:
        neighbours._squares = lambda q, v: seen.append(len(q) * len(v)) or real(q, v)
        x, y, d = neighbours._nearest(z, z[:300] + 0.01, np.full(300, np.inf), 5)
    finally:
        neighbours._squares = real
    far = np.sqrt(((z[None, :, :] - (z[:300] + 0.01)[:, None, :]) ** 2).sum(axis=2))
    assert (y.reshape(300, 5) == np.argsort(far, axis=1, kind="stable")[:, :5]).all() and sum(seen) < 0.1 * far.size


def test_ratios_need_no_shuffle_by_bout(spark):
    """The opponent's running total is a window by opponent, so rows go to the opponent, to the fighter, and are widened; unknown names and
    unknown statistics are as in a plain loop."""
    rnd, rows = random.Random(8), []
    for i in range(150):
        a, b = rnd.sample(["A", "B", "C", "D", None], 2)
        rows.append((f"{i:04}", dt.date(2020, 1, 1 + i // 30), a, b, 1, rnd.choice([None, 0, 1, 5]), rnd.choice([0, 2, 3, None])))
    b = spark.createDataFrame(rows, "bout_id string, dt date, fighter_red string, fighter_blue string, winner int, ctrl_red int, ctrl_blue int")
    df = history.cumulative_ratio(b, "control", "r")
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    had, sums, met, want = {}, {}, set(), {}
    for i, _, *pair, _, x, y in rows:
        before = [had.get(f) for f in pair]
        for k, f in enumerate(pair):
            own, opp = sums.get(f, (0, 0))
            want[i, "red blue".split()[k]] = None if f not in met else own / opp if opp else float(own)
        for k, f in enumerate(pair):
            own, opp = sums.get(f, (0, 0))
            sums[f] = own + (before[k] or 0), opp + (before[1 - k] or 0)
            v = (x, y)[k]
            had[f] = v if had.get(f) is None else had[f] + (v or 0)
        met |= set(pair)
    assert {(r["bout_id"], k): r[f"r_{k}"] for r in df.collect() for k in ("red", "blue")} == want


def test_training_frame_is_one_scan_and_written(spark, view, monkeypatch):
    """Against the split joined with the whole feature table; what is written shuffles rows by fighter and by bout and joins nothing."""
    made = []
    monkeypatch.setattr(learn, "written", lambda df: made.append(df) or tables.written(df))
    view, _ = tables.written(view)
    got = {r["bout_id"]: r.asDict() for r in learn.training_frame(view).collect()}
    split = audit.chronological_split(view.filter("winner in (0, 1)")).select("bout_id", "weight_class", F.col("winner").cast("double").alias("y"), "is_train")
    want = split.join(history.feature_table(view).select("bout_id", *learn.FEATURES), "bout_id").na.fill(0.0, learn.FEATURES)
    assert got == {r["bout_id"]: r.asDict() for r in want.collect()} and len(got) > 1000
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan


def test_pairs_of_odds_are_priced_once(spark):
    """The iteration of the power method is not in the plan over bouts; prices are those of each line by itself, also for odds that are NULL."""
    odds = [(-120, 100, None, 100, -120, 100), (None, None, -120, 100, 150, -170), (100, 100, 150, None, -120, 100)]
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(odds)], "bout_id long, " + ", ".join(f"{n}_{k} int" for n in market.LINES for k in market.CORNERS))
    got = market.odds_features(b)
    assert "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert market.quotes(b).count() == 6
    rows = got.orderBy("bout_id").collect()
    for line in market.LINES:
        names = [f"{n}_{k}_{line}" for n in ("implied", "fair", "fair_odds") for k in market.CORNERS]
        alone = market.devig(market.decimals(b), line).orderBy("bout_id").select(*names).collect()
        assert [[r[n] for n in names] for r in rows] == [list(a) for a in alone]


def test_rows_of_a_bout_meet_once_at_most(spark, view):
    """Neither the state nor new bouts need windows over the two rows of a bout; rows of one bout meet when they are widened."""
    state = incremental.state_after(view)
    for df in (state, incremental.features_after(view, state)):
        assert "windowspecdefinition(bout_id" not in df._jdf.queryExecution().optimizedPlan().toString()
