"""How rows are sent: nothing is lost on the way, and parts grow with the input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ringside.operators import history, match, sending
from ringside.sources import bouts as src

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def view(spark):
    return src.bouts_view(spark, SMALL).persist()


def test_packed_rows_come_back(spark):
    day = dt.date(1995, 3, 15)
    rows = [
        (f"b{i}", day if i % 3 else None, "red" if i % 2 else "blue", ("W", "L", "D", None)[i % 4], x, y, None if i % 5 == 0 else i % 2 == 0, i / 7)
        for i, (x, y) in enumerate([(0, 0), (1, -1), (4095, 1 << 20), (4096, 5), (None, None), (-1, 3), (2**31 - 1, 2**62), (7, None), (5, -(2**63)), (5, 2**63 - 1)])
    ]
    df = spark.createDataFrame(rows, "bout_id string, dt date, corner string, res string, x int, y bigint, own_fav boolean, p double")
    df = df.unionByName(df.select("*").withColumns({"bout_id": F.concat("bout_id", F.lit("'")), "dt": F.lit("3000-01-01").cast("date")}))
    back = sending.sent(df, 3, "bout_id")
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_short_ids_keep_their_order(spark):
    ids = ["000000000001020000000003", "-00000000001020000000003", "000000000010020000000003", "990000000001020000000003", None]
    df = spark.createDataFrame([(x,) for x in ids], "bout_id string")
    short = src.short_ids(df)
    assert [r[0] for r in src.full_ids(short.orderBy("bout_id")).collect()] == [r[0] for r in df.orderBy("bout_id").collect()]
    assert all(len(r[0]) * 2 == len(ids[0]) for r in short.dropna().collect())


def test_parts_grow_with_the_input(spark, monkeypatch):
    """four parts of a session held any number of rows each, and what they couldn't hold was spilled."""
    monkeypatch.setattr(sending.parts, "__defaults__", (5_000,))
    b = src.bouts_view(spark, SMALL.replace("sf0.001", "sf0.01"))
    n = sending.parts(b)
    assert n > 20
    plan = history.totals_per_minute(b)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == plan.count(f"], {n}") == 2


def test_dealt_orders_give_the_same_bouts(spark, view, monkeypatch):
    monkeypatch.setattr(src, "MANY_PARTS", 1)
    monkeypatch.setattr(src, "LINE_PART", 20_000)
    dealt = src.bouts_view(spark, SMALL)
    assert dealt.schema == view.schema
    assert dealt.exceptAll(view).isEmpty() and view.exceptAll(dealt).isEmpty()


def shuffled(spark, run):
    """Rows and bytes that the stages of ``run`` send."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        every = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {every.apply(i).stageId(): every.apply(i) for i in range(every.size())}

    before = stages()
    run().write.format("noop").mode("overwrite").save()
    new = [s for k, s in stages().items() if k not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def test_wins_are_sent_as_lists(spark, view):
    """every win was a row of its own in each of some sixteen groups."""
    rows, _ = shuffled(spark, lambda: history.common_opponents(view))
    assert rows < 8 * view.count()


def test_common_opponents_without_dates(spark):
    day = dt.date(2020, 1, 1)
    rows = [("b1", None, "A", "B", 1), ("b2", day, "B", "C", 1), ("b3", day, "A", "C", 1), ("b4", None, "A", "C", 1), ("b5", day, "C", "A", 0), ("b0", day, "A", "C", 0), ("b6", day, None, "C", 0)]
    b = spark.createDataFrame(rows, "bout_id string, dt date, fighter_red string, fighter_blue string, winner int")
    got = {r["bout_id"]: (r["mma_math_red"], r["mma_math_blue"]) for r in history.common_opponents(b).collect()}
    assert got == {"b0": (0, 0), "b1": (0, 0), "b2": (0, 1), "b3": (1, 0), "b4": (0, 0), "b5": (0, 1), "b6": (0, 0)}


def test_counts_are_sent_instead_of_features(spark, view):
    """some eighty features a corner were sent to the bout, half of them doubles."""
    _, table = shuffled(spark, lambda: history.feature_table(view))
    assert table < 700 * view.count()


def test_names_are_sent_once(spark):
    """a name was sent once for every set of characters that fits it."""
    left = spark.createDataFrame([(k, f"F{i}") for k in "xy" for i in range(400)], "card string, red string")
    right = spark.createDataFrame([(k, f"F{i}") for k in "xz" for i in range(300)] + [("x", None), (None, "F1")], "card string, blue string")
    of = lambda tokens=False: match.match_names(left, right, "card", "red", "blue", tokens, block=50)
    sets = [set(f"F{i}") for i in range(400)]
    want = {("x", f"F{i}", f"F{j}") for i in range(400) for j in range(300) if sets[i] <= sets[j] or sets[j] <= sets[i]}
    got = [tuple(r) for r in of().collect()]
    assert len(got) == len(want) and set(got) == want
    rows, _ = shuffled(spark, of)
    assert rows < 8_000
