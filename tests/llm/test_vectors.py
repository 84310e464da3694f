"""Vector operators against brute force, components against union-find, and the pipeline."""

import os
import random
import threading

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ringside.llm import common, components, mixing, pii, pq_dedup, spann

SCHEMA = "vec_id long, embedding array<float>, label int, key string, list string, n string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, exact and near copies, a hot label, repeated and missing ids, and rows that take no part; the further
    columns have names that the operators use inside."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 16))
    rows = []
    for k in range(300):
        v = centers[k % 6] * 0.7 + rng.normal(size=16)
        rows.append((k, v.tolist(), 0 if k % 3 else k % 5))
    for k in range(150):  # near copies, and every fifth an exact one
        v = np.array(rows[k % 20][1]) + (0 if k % 5 == 0 else 1) * rng.normal(size=16) * 0.15
        rows.append((1000 + k, v.tolist(), rows[k % 20][2]))
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] + [1.0] * 15, 0), (2003, [None] + [1.0] * 15, 0), (2004, rows[0][1], None), (2005, [1.0, 2.0], 0)]
    rows += [(2006, [float("inf")] + [1.0] * 15, 0), (2007, [], 0), (2008, [2.0, 4.1], 0), (2009, [2.0, -4.0], 0)]
    rows += [rows[7], rows[7], (7, rows[8][1], 0), (None, rows[1][1], rows[1][2]), (None, rows[1][1], rows[1][2]), (None, [-5.0] * 16, 0), (None, None, None)]
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA)


def usable(r):
    e = r["embedding"]
    return bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)


def good(rows):
    return [r for r in rows if usable(r)]


def brute_links(rows, threshold=0.93):
    """(vec_id, n_links, component_id) of every row, by comparing all pairs of rows."""
    up, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    use = [k for k, r in enumerate(rows) if usable(r) and r["label"] is not None]
    unit = {k: np.array(rows[k]["embedding"]) / np.linalg.norm(rows[k]["embedding"]) for k in use}
    for i, a in enumerate(use):
        for b in use[:i]:
            if rows[a]["label"] == rows[b]["label"] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a], n[b] = n[a] + 1, n[b] + 1
                up[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, r in enumerate(rows):
        if r["vec_id"] is not None:
            least[find(k)] = min(r["vec_id"], least.get(find(k), r["vec_id"]))
    return sorted((str(r["vec_id"]), n[k], str(least.get(find(k)))) for k, r in enumerate(rows))


@pytest.mark.parametrize(("list_rows", "block"), [(10, 8), (100, 64), (4096, 4096)])
def test_near_duplicates(vectors, list_rows, block):
    rows = vectors.collect()
    got = pq_dedup.near_duplicates(vectors, list_rows=list_rows, block=block).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_links(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_sql(spark):
    """Planted copies in many lists at the default settings, against the SQL of the query."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(700, 64))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 64)) * 0.3, base[:60] + rng.normal(size=(60, 64)) * 0.25, np.repeat(base[3:4], 30, axis=0)])
    rows = [(k, v.tolist(), int(k % 700 % 4)) for k, v in enumerate(x)] + [(900, None, 1), (901, x[5].tolist(), None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    db = duckdb.connect()
    db.register("made", df.toArrow())
    db.execute("create view embeddings as select * from made")
    want = sorted(db.execute(pq_dedup.OP1_SQL).fetchall())
    got = sorted(map(tuple, pq_dedup.near_duplicates(df, list_rows=20).collect()))
    assert got == want and sum(r[1] for r in want) > 500


def test_links_of_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.99, 0.05], 1), (None, [0.99, 0.06], 1)]
    got = pq_dedup.op1_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in got) == [("1", 2, 1, True), ("1", 2, 1, True), ("None", 2, 1, False)]
    assert pq_dedup.op1_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trees_have_bounded_degree():
    edges = list(pq_dedup.tree(list(range(1000))))
    degree = np.bincount(np.array(edges).ravel())
    assert len(edges) == 999 and degree.max() <= pq_dedup.FANOUT + 1
    hits = np.random.default_rng(1).random((30, 40)) < 0.03
    members = list(pq_dedup.forest(hits))
    assert sorted(k for m in members for k in m) == sorted([*np.flatnonzero(hits.any(axis=1)), *(30 + np.flatnonzero(hits.any(axis=0)))])
    side = {k: i for i, m in enumerate(members) for k in m}
    assert all(side[r] == side[30 + c] for r, c in zip(*np.nonzero(hits), strict=True))


def brute_nearest(rows, q, k=10):
    x = np.array(q["embedding"])
    return sorted((float(np.sqrt(((np.array(r["embedding"]) - x) ** 2).sum())), r["vec_id"]) for r in rows if r["vec_id"] != q["vec_id"] and len(r["embedding"]) == len(x))[:k]


def test_nearest_recall(vectors, spark):
    rows = [r for r in good(vectors.collect()) if r["vec_id"] is not None]
    rows = list({(r["vec_id"], tuple(r["embedding"])): r for r in rows}.values())
    hit = total = 0
    got = spann.op7_ann(vectors).collect()
    for q in [r for r in rows if r["vec_id"] % 100 == 0]:
        near = brute_nearest(rows, q)
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q["vec_id"])
        assert [m[0] for m in mine] == list(range(1, len(near) + 1)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        want = {b: a for a, b in near}
        hit += sum(m[1] in want for m in mine)
        assert all(m[2] == pytest.approx(want[m[1]], abs=1e-12) for m in mine if m[1] in want)
        total += len(near)
    assert hit / total >= 0.95
    assert spann.op7_ann(vectors.limit(0)).count() == 0
    few = spann.op7_ann(vectors.filter("vec_id < 4")).collect()
    assert [r["query_id"] for r in few] == [0, 0, 0]


def test_nearest_ties_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *[(k, [1.0, 1.0]) for k in range(50, 1, -1)], (60, [1.0, 0.5]), (60, [1.0, 0.25]), (None, [1.0, 0.0])]
    got = spann.op7_ann(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(1, 60, 0.25), (2, 60, 0.5), *[(k, k - 1, 1.0) for k in range(3, 11)]]


def test_nearest_prunes_clusters(spark):
    """Where vectors have clusters, few lists hold nearly all neighbours."""
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(60, 64))
    x = centers[rng.integers(0, 60, 6000)] + 0.5 * rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    asks = F.col("vec_id") % 100 == 0
    got = spann.nearest(df, asks, list_rows=60).collect()
    want = {(q, int(j)) for q in range(0, 6000, 100) for j in np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:11]}
    assert len(want & {(r["query_id"], r["vec_id"]) for r in got}) >= 0.95 * len(want)
    assert spann.scanned_share(df, asks, list_rows=60) <= 0.1


def test_search_without_clusters_compares_nothing_twice(spark):
    """Directions at random: recall against brute force, and less than the whole table for a query; the driver's tables too."""
    x = np.random.default_rng(12).normal(size=(8000, 48)).astype("float32")
    made = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    for df in (made, spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")):
        every = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in df.select("vec_id", "embedding").filter("embedding is not null").collect()}
        ids, v = np.array(list(every)), np.stack(list(every.values()))
        found = {}
        for r in spann.op7_ann(df).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for i, got in found.items():
            d = ((v - every[i]) ** 2).sum(axis=1)
            d[ids == i] = np.inf
            hits += len(got & set(ids[np.argsort(d, kind="stable")[:10]].tolist()))
        assert hits >= 0.9 * 10 * len(found) and spann.scanned_share(df, F.col("vec_id") % 100 == 0) <= 1


def test_components(spark):
    rng = random.Random(8)
    for edges in ([(k, k + 1) for k in range(1000)], [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(1, 1), (None, 2), (203, 204), (204, 203)], [(rng.randrange(200), rng.randrange(200)) for _ in range(120)], []):
        up = {}

        def find(x, up=up):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in edges:
            if a is not None and a != b:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r["id"]: r["component"] for r in got} == {x: find(x) for x in up}


def test_stages_against_plain_versions(spark):
    """near_copies keeps the smallest id of each group; mixture repeats a document as the plan and its draw say."""
    from test_text import brute_groups

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_copies", F.lit(7)).withColumn("_key", F.lit(8))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_copies"](spark, docs, sf)
    groups = brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80, 100)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in groups.items() if i == c)
    draw = {r["doc_id"]: r["d"] / (1 << 20) for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(corpus_pipeline.SEED)), F.lit(1 << 20)).alias("d")).collect()}
    want = {}
    for r in mixing.mix_sources(docs).collect():
        times = r["taken"] / r["size"] if r["size"] else 0
        want[r["doc_id"]] = int(times) + (draw[r["doc_id"]] < times - int(times))
    mixed = stages["mixture"](spark, docs, sf)
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in want.items() if n}
    assert {(r["_copies"], r["_key"]) for r in mixed.collect()} == {(7, 8)} and mixed.columns == docs.columns


def test_rows_without_id_in_the_pipeline(spark):
    rows = [(1, "a b c d e f g"), (None, "a b c d e f g"), (None, "q w e r t y u"), (None, "q w e r t y u"), (None, None), (3, ""), (3, "")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["near_copies"](spark, docs, "")
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == [("1", "a b c d e f g"), ("3", ""), ("3", ""), ("None", "None"), ("None", "q w e r t y u")]


def test_tables_are_removed(spark):
    """Each call deletes its own tables only, also beside another thread's; a kept one passes to the call around it."""
    made, barrier = {}, threading.Barrier(2)
    there = lambda df: os.path.isdir(df._stable_at)

    def call(name, late):
        with common.cleared(spark):
            with common.cleared(spark, lambda: out):
                spare, out = common.stable(spark.range(3)), common.stable(spark.range(4))
            barrier.wait()
            made[name] = there(spare), there(out)
            if late:
                barrier.wait()  # the other call has ended
            made[name] += (out.count(),)
        if not late:
            barrier.wait()
        made[name] += (there(out),)

    threads = [threading.Thread(target=call, args=(n, n == "b")) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert made == dict.fromkeys("ab", (False, True, 4, False))
    out = components.connected_components(spark.createDataFrame([(1, 2)], "a long, b long"))
    assert there(out) and out.count() == 2
    common.drop(out)
    assert not there(out)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["near_copies"](spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    hidden = stages["privacy"](spark, docs, sf).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect()
    assert all(r["text"] == pii.redact_text(r["was"]) and r["n_chars"] == len(r["text"]) for r in hidden)
    mixed = stages["mixture"](spark, docs, sf).groupBy("doc_id").count().collect()
    plan = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix_sources(docs).collect() if r["size"]}
    assert all(int(plan[r["doc_id"]]) <= r["count"] <= int(plan[r["doc_id"]]) + 1 for r in mixed)
    odd = spark.createDataFrame([(None, None, None, None, None), (7, "", None, "a", 0), (8, "x", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    for name in ("toxicity", "privacy", "mixture", "tokens"):
        assert stages[name](spark, odd, sf).count() <= 9
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids"] and out.filter("n_tokens <> size(ids)").count() == 0


def test_mixture_of_rows_without_id(spark):
    """Each source gets its words, however many rows lack an id, whether or not their texts are alike."""
    rows = [(k, "w " * 30, "a") for k in range(100)] + [(None, f"n{k} " * 30, "a") for k in range(10)]
    rows += [(None, f"m{k} " * 30, "b") for k in range(200)] + [(None, "same " * 30, "b") for _ in range(100)] + [(1000, "w " * 5000, "c"), (None, None, "b"), (None, "", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, source string, n_chars int, _name string")
    target = {r["key"][1:]: r["target"] for r in mixing.mix_sources(docs).filter("source_size > 0").select("key", "target").distinct().collect()}
    out = dict(corpus_pipeline.STAGES)["mixture"](spark, docs, "")
    assert out.columns == docs.columns
    words = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert {"a", "b"} <= set(words) and all(abs(words[s] - target[s]) <= 0.15 * target[s] for s in "ab")
    most = {r["doc_id"]: r["count"] for r in out.filter("doc_id is not null").groupBy("doc_id").count().collect()}
    assert max(most.values()) <= 3
    long = spark.createDataFrame([(1, "w " * 200_000, "a", 0, "x"), (2, "w", "a", 0, "x")], docs.schema)
    assert dict(corpus_pipeline.STAGES)["mixture"](spark, long, "").count() == 2  # one source stays as it is
