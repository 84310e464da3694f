"""The manifest, the removal of repeated passages and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from ringside.llm import filter_audit, manifest, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part int, id string, h string"


def frame(spark, rows):
    """Rows (doc_id, text, lang) with a source and further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, None if k % 7 == 3 else f"s{k % 3}", None if t is None else len(t), 1, "x", "y") for k, (i, t, lang) in enumerate(rows)], SCHEMA)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_manifest(rows):
    def leaf(r, text):
        fields = [None if x is None else str(x) for x in (r.doc_id, r.source, r.lang, r.n_chars, text)]
        return sha("".join("-" if x is None else f"{len(x.encode())}:{x}" for x in fields))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def way(steps, pos):
        for nodes in steps[:-1]:
            a = pos - pos % 8
            yield nodes[a:pos], nodes[pos + 1 : a + 8]
            pos //= 8

    groups = {}
    for r in rows:
        groups.setdefault(None if r.lang is None else r.lang.encode(), []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda g: (g is not None, g or b""))
    trees = [levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for g, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for pos, (_, _, own, r) in enumerate(sorted(groups[name], key=lambda x: x[:3])):
            text = r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            now, proof = leaf(r, text), ""
            for left, right in [*way(tree, pos), *way(top, g)]:
                proof += "".join(left + right)
                now = sha("".join([*left, now, *right]))
            root = top[-1][0]
            out.append((r.doc_id, own, tree[-1][0], root, sha(proof), now, now == root))
    return sorted(out, key=str)


def manifest_rows(name):
    texts = ["", None, "Small TEXT", "lower case only", "x" * 200_000, "Ünïcode Ä"]
    if name == "groups":  # heights 0 to 3, a null and an empty group, missing and repeated ids, repeated rows
        sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "é": 65, None: 520, "": 3, "z": 2}
        rows = [(1000 * k + j, texts[(j * j + k) % 6] if j < 30 else f"T {j} {k}", g) for k, (g, n) in enumerate(sizes.items()) for j in range(n)]
        return rows + [(None, "NULL id", "c"), (None, "NULL id", "c"), (2001, "again", "c"), (2000, "T", "c"), (2000, "T", "c")]
    if name == "many groups":
        return [(k, f"Text {k}", f"g{k:03}") for k in range(150)] + [(200 + k, "A", "g077") for k in range(20)]
    if name == "one group":
        return [(k, f"Text {k}", "en") for k in range(100)]
    return {"one row": [(3, "Only", None)], "two groups of one": [(3, "Only", None), (4, "Other", "x")]}[name]


@pytest.mark.parametrize("name", ["groups", "many groups", "one group", "one row", "two groups of one"])
def test_manifest(spark, name):
    docs = frame(spark, manifest_rows(name)).repartition(5)
    got = sorted((tuple(r) for r in manifest.op11_merkle(docs).collect()), key=str)
    assert got == plain_manifest(docs.collect())
    if name == "groups":
        assert {v for *_, v in got} == {True, False}


def test_manifest_of_nothing(spark):
    out = manifest.op11_merkle(frame(spark, [(1, "x", "y")]).limit(0))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def plain_removal(rows, width):
    """By position: which windows start earlier too."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, rows[k][2]))
    seen, out = set(), []
    for k in order:
        i, text, _ = rows[k]
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s in seen:
                gone[p : p + width] = b"\1" * width
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, small):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé" if small else "abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(12), text(25), text(40), "license " * 30, text(18)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(text(rng.randint(1, 30)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 40) :])
        rows.append((k * 3, rng.choice([" ", ""]).join(parts)))
    rows += [(k + 1, rows[k][1]) for k in range(0, 60, 5)]  # copies
    rows += [(900, None), (901, ""), (902, "a" * 99), (903, "a" * 100), (904, "a" * 350), (905, "ab" * 200), (None, rows[3][1]), (None, text(50)), (7, text(60)), (7, shared[2] * 2)]
    rows += [(905, "ab" * 200), (950, text(3000) + shared[1] + text(20)), (951, shared[1] + " " + shared[1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "crowd", "chunk"), [(1, 4096, 1 << 21), (2, 2, 1500), (3, 5, 900)])
def test_repeats_are_removed(spark, monkeypatch, seed, crowd, chunk):
    """Small chunks cut long texts in pieces; small crowds send most windows through the ranges."""
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes, "SEND", 4 * chunk)
    monkeypatch.setattr(suffixes, "BUCKET", 4000)
    docs = frame(spark, [(i, t, "en") for i, t in passages(seed, seed > 1)]).repartition(6)
    hashed = docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) as th").collect()
    got = suffixes.remove_repeats(docs, crowd=crowd, texts=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_removal([tuple(r) for r in hashed], 100)
    assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) and len(r["spans"]) == r["n_spans"] for r in got)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got if "�" not in r["kept"])


def test_common_anchors_only_spread(spark, monkeypatch):
    """A line that most documents hold: dealt by fingerprint, with the same result."""
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    line = noise(150)
    docs = frame(spark, [(k, noise(rng.randint(20, 120)) + line + noise(rng.randint(20, 120)), None) for k in range(400)])
    found = {}
    real = suffixes._common_anchors
    monkeypatch.setattr(suffixes, "_common_anchors", lambda *a: found.setdefault("anchors", real(*a, sample=2)))
    got = sorted((tuple(r) for r in suffixes.op12_suffix_dedup(docs).collect()), key=str)
    assert len(found["anchors"]) and got == plain_removal([(r.doc_id, r.text, 0) for r in docs.collect()], 100)


def test_nothing_to_remove(spark):
    assert suffixes.op12_suffix_dedup(frame(spark, [(1, "x", "y")]).limit(0)).count() == 0
    assert [tuple(r)[1:4] for r in suffixes.op12_suffix_dedup(frame(spark, [(1, "x", "y")])).collect()] == [(1, 0, 0)]


def test_multikey_quicksort():
    rng = np.random.default_rng(2)
    strings = rng.integers(97, 99, (500, 21)).astype(np.uint8)
    strings[:, 3:] = strings[rng.integers(0, 30, 500), 3:]
    order, begins = suffixes.multikey_order(strings)
    rows = [s.tobytes() for s in strings[order]]
    assert rows == sorted(rows) and begins.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(500)]


def plain_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), i is not None and i > first[t],
        )
        return {f for f, bad in zip("ABCDE", checks, strict=True) if bad}

    docs = [(lang or "", fails(i, t), *labels.get(i, (0, 0))) for i, t, lang in rows]
    out, total = {}, {}
    for order in map("".join, itertools.permutations("ABCDE")):
        for lang, bad, good, toxic in docs:
            for step, f in enumerate(order, 1):
                c = out.setdefault((lang, order, step), [0] * 6)
                earlier = bad & set(order[: step - 1])
                c[0] += not bad & set(order[:step])
                c[1] += f in bad and not earlier
                c[2] += f in bad and bool(earlier)
                c[3] += bad == {f}
                c[4] += f in bad and not earlier and good == 1
                c[5] += f in bad and not earlier and toxic == 1
                total[lang, f] = total.get((lang, f), 0) + (f in bad and not earlier)
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_filter_audit(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcDEF") if rng.random() < 0.2 else rng.choice("abcdefgh") for _ in range(rng.randint(1, 5)))
    text = lambda n: rng.choice([" ", "\n", "  "]).join(word() for _ in range(n)) + rng.choice(["", "#", " ½"])
    rows = [(k, text(rng.choice([3, 60, 99, 100, 101, 140, 300])), rng.choice(["en", "de", None, ""])) for k in range(150)]
    rows += [(1000 + k, rows[7][1], "en") for k in range(120)]  # one text stretches over several ranges
    rows += [(k, rows[k - 1][1], "de") for k in range(150, 160)] + [(160, rows[5][1], "de"), (160, rows[5][1], "de"), (None, rows[7][1], "en"), (None, "lone", "en"), (None, "lone", "xx"), (5000, "lone", "xx")]
    rows += [(2000, None, "en"), (2001, "", "en"), (2002, "", None), (2003, "word " * 50_000, "fr"), (7, rows[7][1], "en")]
    labels = {i: (rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, *_ in rows if i is not None and rng.random() < 0.5}
    docs = frame(spark, rows).repartition(7)
    got = filter_audit.op13_filter_audit(docs, spark.createDataFrame([(i, *x) for i, x in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(rows, labels)
    assert filter_audit.op13_filter_audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_copies_by_full_text_under_one_fingerprint():
    """Texts that collide are kept apart; only first rows at either end of a range report their text."""
    rows = [(1, "en", 0, 5, 0, "a"), (4, "en", 0, 5, 0, "a"), (2, "en", 0, 5, 0, "b"), (2, "en", 0, 5, 0, "b"), (None, "en", 0, 6, 0, "c"), (3, "en", 0, 6, 0, "c"), (9, "en", 0, 7, 0, "d")]
    names = ["id", "lang", "mask", "h", "part", "text"]
    batches = (pa.RecordBatch.from_pandas(pd.DataFrame(rows[k : k + 2], columns=names).astype({"id": "Int64"}), preserve_index=False) for k in range(0, 7, 2))
    got = [r for b in filter_audit._mark(batches) for r in b.to_pylist()]
    assert sorted((str(r["id"]), r["mask"], r["edge"]) for r in got) == [("1", 0, "a"), ("2", 0, "b"), ("2", 0, "b"), ("3", 0, None), ("4", 16, None), ("9", 0, "d"), ("None", 0, None)]
