"""Text operators against brute force, exact round trips and held-out accuracy; nulls, ties, empty tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ringside.llm import bpe, chat, jaccard, langid, mixing, pii, sharding, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = r"[^\x20\x09-\x0D]+"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows beside hard ones: null and empty texts, null ids' neighbours, copies, one long text, a clashing column."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(120)) for _ in range(6)]
    rows = [(k, t, "en", "s1", 1, "x") for k, t in enumerate(base)]
    for k in range(40):  # near copies
        words = base[k % 3].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = word()
        rows.append((100 + k, " ".join(words), "en", "s2" if k % 2 else None, None, None))
    rows += [(200, None, None, None, None, None), (201, "", "en", "", 0, None), (202, " \n ", None, "é", 0, None), (203, "one two", "fr", "s1", 0, None), (204, "ONE two", "fr", "s1", 0, None)]
    rows += [(205, base[0], "en", "s3", 0, None), (206, " ".join(word() for _ in range(20_000)), "en", "s3", 0, None)]
    return spark.createDataFrame(rows, DOCS)


def brute_groups(rows, words, num, den):
    sets = {}
    for i, text in rows:
        w = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("words", "num", "den"), [(4, 85, 100), (5, 80, 100), (4, 60, 100)])
def test_jaccard_brute_force(docs, words, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # many blocks and leaders even here
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(docs, words, num, den).collect()}
    assert got == brute_groups([(r["doc_id"], r["text"]) for r in docs.collect()], words, num, den)


def test_jaccard_links_to_the_largest_component(spark, monkeypatch):
    """Satellites that each link with one variant only, by n-grams that hundreds of sets share."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    rng = random.Random(7)
    common = [f"w{k}" for k in range(100)]
    rows = []
    for k in range(100):
        without = rng.sample(common, 15)
        rows += [(k, " ".join(w for w in common if w not in without[:7])), (1000 + k, " ".join(w for w in common if w not in without))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()}
    assert got == brute_groups(rows, 1, 85, 100)


def test_jaccard_form_letters_stay_in_small_groups(spark, monkeypatch):
    """Letters of 27 n-grams that share 23 and don't link: no group holds more than two blocks, and none is needed."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEADERS", 2)
    seen, links = [], jaccard._links
    monkeypatch.setattr(jaccard, "_links", lambda members, *rest: (seen.append([r["n"] for r in members.select(F.size("rows").alias("n")).collect()]), links(members, *rest))[1])
    form = [f"w{k}" for k in range(30)]
    rows = [(k, " ".join([*form[:15], f"name{k}", *form[16:]])) for k in range(300)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (27, k) for k, _ in rows}
    assert len(seen) == 2 and sum(seen[1]) == 0 and max(seen[0]) < 40


def test_jaccard_empty_and_null_ids(spark, docs):
    assert jaccard.op5_jaccard(docs.limit(0)).count() == 0
    some = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, None)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.op5_jaccard(some).collect()) == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]


def test_bpe_equals_the_library(docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    hard = ["", "<|endoftext|>a<|startoftext|> B", "it's DON'T we'LL ſ Ⅷ ½ ²", "a" * 3000, "the" * 1000 + "!!!" * 300, "ΑΣ ΑΣΑ  x\u0085y", "é́ 漢字 한글 ё́ 😀"]
    hard += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz'éßΣ 0123.,!\n") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    v = bpe.Vocabulary(open(bpe.vocabulary_path(), encoding="utf-8").read())
    for text, (ids, n, decoded) in zip(hard, bpe.Encoder(v).texts(hard), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert (ids, n, decoded) == (" ".join(map(str, want)), len(want), t.decode(want, skip_special_tokens=False)), text[:60]
    got = {r["doc_id"]: r for r in bpe.op9_bpe(docs).collect()}
    for r in docs.collect():
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"]) == (len(want), sha(" ".join(map(str, want))))
    back = bpe.decode(bpe.encode(docs, ["doc_id"])).collect()
    assert all(r["n_tokens"] == len(r["ids"]) and sha(r["decoded"]) == got[r["doc_id"]]["decoded_sha256"] for r in back)
    assert bpe.op9_bpe(docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "<", "[", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<<END>>", "ok", "\n", "é", "/"]
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "system", "tool", None, "<s>"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for c in range(60) for k in range(rng.randint(1, 6))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, conv_id2 string")
    want = defaultdict(list)
    for c, _, role, text in rows:
        want[c].append((role or "", text or ""))
    out = chat.format_chats(df).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    assert {r["conv_id"]: [tuple(t) for t in r["back"]] for r in out} == dict(want)
    done = {r["conv_id"]: r for r in chat.op2_chat(df).collect()}
    for c, turns in want.items():
        said = "".join(t for role, t in turns if role == "assistant")
        assert (done[c]["turns_sha256"], done[c]["loss_sha256"], done[c]["loss_chars"]) == (sha("".join(f"{a}\n{b}\n" for a, b in turns)), sha(said), len(said))
    assert done[-1]["valid"] and chat.op2_chat(df.limit(0)).count() == 1


def test_chat_order_machine(spark):
    cases = {1: ("system user assistant", None), 2: ("user user", 1), 3: ("user assistant user", 3), 4: ("assistant", 0)}
    df = spark.createDataFrame([(c, k, r, "x") for c, (s, _) in cases.items() for k, r in enumerate(s.split())], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["valid"], r["error_at"]) for r in chat.format_chats(df).collect()} == {c: (e is None, e) for c, (_, e) in cases.items()}


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hard = spark.createDataFrame([(-1, None), (-2, ""), (-3, "123 !!"), (-4, "привет мир")], "doc_id long, text string")
    got = langid.op3_langid(df.unionByName(hard, allowMissingColumns=True)).join(df.select("doc_id", "lang"), "doc_id", "left").collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (-1, -2, -3)} == {-1: "und", -2: "und", -3: "und"}
    held = [r for r in got if r["doc_id"] >= 0 and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert {r["lang_pred"] for r in langid.op3_langid(df.filter("lang is null")).collect()} <= {"und"}


def test_viterbi_equals_brute_force():
    import numpy as np

    m = langid.build([{"lang": a, "gram": g, "n": n} for a, g, n in [("x", "^ab", 5), ("x", "ab$", 5), ("y", "^cd", 5), ("y", "cd$", 5), ("x", "script latin", 9), ("y", "script latin", 9)]], 1.5)
    rng = random.Random(3)
    for _ in range(30):
        words = [rng.choice(["ab", "cd", "ef"]) for _ in range(rng.randint(1, 8))]
        path = m.spans([words])[0]
        s = m.score_words(words)
        value = lambda q: sum(s[k, a] for k, a in enumerate(q)) - 1.5 * sum(a != b for a, b in zip(q, q[1:], strict=False))  # noqa: B023, E731
        best = max(value(q) for q in np.ndindex(*[2] * len(words)))
        assert abs(value(tuple(path)) - best) < 1e-4


def test_toxicity_folding_and_held_out(spark):
    lex = toxicity.Lexicon({toxicity.fold("idiot"): (5.0, False), toxicity.fold("trash"): (5.0, False)}, [toxicity.fold("trash can")])
    a = lex.automaton()
    hit = lambda t: lex.features(a, t)[0] > 0
    assert all(hit(t) for t in ("you IDIOT.", "1d10t!", "іdіоt", "i​diot", "ìdíöt")) and not any(hit(t) for t in ("idiotic", "the trash can", "", "patriot"))
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity.op4_toxicity(df, labels).join(labels, "doc_id").filter("held_out").collect()
    tp = sum(r["predicted"] and r["toxic"] for r in got)
    assert tp / sum(r["toxic"] for r in got) > 0.8 and tp / sum(r["predicted"] for r in got) > 0.85
    assert toxicity.op4_toxicity(df.limit(0), labels.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.op4_toxicity(odd, labels.limit(0)).collect()] == [0, 0]


def plain_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans(spark, docs):
    rng = random.Random(5)
    bits = ["a@b.co", "x", "@", ".", "1", "42", "255.1.", "+1 (555) 123-4567", "4111 1111 1111 1111", "-", " ", "é", "+", "a.b@c.d.", "256", "0000.0.0.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for t in texts:
        found = pii.base_spans(t)
        assert [(k, a, b) for k in pii.BASE for a, b in found[k]] == plain_spans(t), t
    assert pii.find_spans("iban DE89 3704 0044 0532 0130 00 ok")[-1][:3] == ("iban", 5, 32)
    assert pii.find_spans("DE89370400440532013000 BIC COBADEFFXXX")[0][:3] == ("iban", 0, 22) and pii.find_spans("DE89 3704 0044 0532 0130 00 EUR 50")[0][:3] == ("iban", 0, 27)
    assert [s[:3] for s in pii.find_spans('API_KEY: "9233a8ecf7c5b09fe594" token=aaaaaaaaaaaaaaaaaaaa')] == [("secret", 10, 30)]
    assert pii.redact_text("mail bob@x.org now") == "mail <EMAIL> now"
    got = {r["doc_id"]: r for r in pii.op6_pii(docs).collect()}
    assert all(got[r["doc_id"]]["base_sha256"] == sha(pii.digest(plain_spans(r["text"] or ""))) for r in docs.collect())
    assert pii.op6_pii(docs.limit(0)).count() == 0


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not over:
            out |= {s: w[s] * level for s in open_}
            break
        out |= {s: most * sizes[s] for s in over}
        open_ -= set(over)
    return out


def test_mixing(docs):
    got = mixing.op8_mixing(docs).collect()
    size = {r["doc_id"]: len(re.findall(WORDS, r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sizes = defaultdict(int)
    for i, s in source.items():
        sizes[s] += size[i]
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] + 2 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op8_mixing(docs.repartition(5)).collect()))
    assert mixing.op8_mixing(docs.limit(0)).count() == 0


def test_apportionment_equals_a_heap(spark):
    rng = random.Random(6)
    groups = {g: ([rng.choice([0, 1, 2, 3, 50, 1000]) for _ in range(12)], rng.randint(0, 400)) for g in range(20)}
    df = spark.createDataFrame([(g, k, w, n) for g, (ws, n) in groups.items() for k, w in enumerate(ws)], "g int, k int, w long, n long")
    got = {(r["g"], r["k"]): r["q"] for r in mixing.apportion(df, ["g"], "w", "n", ["k"], "q").collect()}
    for g, (ws, n) in groups.items():
        seats, heap = [0] * len(ws), [(-w, k) for k, w in enumerate(ws) if w]
        heapq.heapify(heap)
        for _ in range(n if heap else 0):
            _, k = heapq.heappop(heap)
            seats[k] += 1
            heapq.heappush(heap, (-ws[k] / (2 * seats[k] + 1), k))
        assert [got[g, k] for k in range(len(ws))] == seats


def test_sharding(docs):
    got = sharding.op10_sharding(docs).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(text[r["doc_id"]].encode()) + 8, zlib.crc32(text[r["doc_id"]].encode())) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(24))
    assert sharding.op10_sharding(docs.limit(0)).count() == 0


def test_shard_sizes_and_copies(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 9000).cast("string"))).alias("text"))
    out = sharding.shard_documents(rows, id_col="id")
    size = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(size) == 24 and max(size) <= 1.05 * min(size)
    small = out.join(rows, "id").filter("text <> 'hot'").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert small.filter("n > 1").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size string, shard int, h int, term string, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, ids without text, texts without id, one very long text, ties; further columns have names that the
    operators use inside."""
    said = "You are a pathetic 1d10t, mail bob@x.org or call +1 (555) 123-4567 now"
    long = " ".join(f"word{k % 97}" for k in range(150_000))
    rows = [(1, said, "en", "a"), (1, said, "en", "a"), (1, "another text", "en", "a"), (None, said, "en", "a"), (None, None, None, None), (2, None, "fr", None), (3, "", None, ""), (4, long, "en", "b"), (5, "x", "fr", "b"), (6, "x", "fr", "b")]
    return spark.createDataFrame([(*r, 7, "i", "k", "s", 1, 2, "t", "p") for r in rows], ODD)


def test_odd_tables_keep_every_row(spark, odd):
    """Every operator gives one row for each row, equal rows alike, with the defined values of null and empty texts."""
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1)], "doc_id long, toxic int")
    ids = sorted(str(r["doc_id"]) for r in odd.collect())
    out = {
        "lang": langid.op3_langid(odd), "toxic": toxicity.op4_toxicity(odd, labels), "grams": jaccard.op5_jaccard(odd), "pii": pii.op6_pii(odd),
        "mix": mixing.op8_mixing(odd), "bpe": bpe.op9_bpe(odd), "shards": sharding.op10_sharding(odd),
    }
    got = {k: v.collect() for k, v in out.items()}
    for name, rows in got.items():
        assert sorted(str(r["doc_id"]) for r in rows) == ids, name
    of = lambda name, i: [r for r in got[name] if r["doc_id"] == i]
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for i in (2, 3) for r in of("lang", i)) and {r["held_out"] for r in of("lang", None)} == {False}
    assert len({r["score"] for i in (2, 3) for r in of("toxic", i)}) == 1 and all(0 <= r["score"] <= 1 for r in got["toxic"])
    assert sorted((r["n_shingles"], str(r["component_id"])) for r in of("grams", None)) == [(0, "None"), (10, "1")] and [r["component_id"] for i in (5, 6) for r in of("grams", i)] == [5, 5]
    assert sorted((r["n_email"], r["n_phone"]) for r in of("pii", 1)) == [(0, 0), (1, 1), (1, 1)] and [r["spans"] for i in (2, 3) for r in of("pii", i)] == ["", ""]
    assert all(r["taken"] == 0 for i in (2, 3) for r in of("mix", i)) and all(r["taken"] <= 3 * r["size"] for r in got["mix"])
    assert all(r["n_tokens"] == 0 for i in (2, 3) for r in of("bpe", i)) and of("bpe", 4)[0]["n_tokens"] >= 150_000
    assert len({(r["shard"], r["slot"]) for r in got["shards"]}) == len(ids) and sorted(r["size"] for i in (2, 3) for r in of("shards", i)) == [8, 8]


def test_toxicity_equals_plain_search(spark, docs):
    """Scores against a search of each term from every place, with exceptions tested one by one."""
    lex = toxicity.Lexicon({"abc": (2.0, True), "ab": (1.5, False), "de": (3.0, False), "fga": (-1.0, True)}, ["ab de", "xab"], [-2.0, 0.7, 0.4, 5.0])
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["ab", "abc", "abcd", "de", "DE", "fgaz", "xab", "4b", "q", "ab de"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(rows, lex).collect()}
    for k, text in enumerate(texts):
        t = toxicity.fold(text)
        free = lambda i, n: (i == 0 or not t[i - 1].isalnum()) and (i + n == len(t) or not t[i + n].isalnum())  # noqa: B023, E731
        spared = [(i, i + len(e)) for e in lex.exceptions for i in range(len(t)) if t.startswith(e, i) and free(i, len(e))]
        at = {}
        for term, (w, beginning) in lex.terms.items():
            for i in (i for i in range(len(t)) if t.startswith(term, i)):
                whole = (i == 0 or not t[i - 1].isalnum()) and (beginning or i + len(term) == len(t) or not t[i + len(term)].isalnum())
                if whole and not any(a <= i and i + len(term) <= b for a, b in spared):
                    at[i] = max(w, at.get(i, w))
        words, weights = max(1, len(re.findall(r"[^\W_]+", t))), [w for w in at.values() if w > 0]
        f = (max(weights, default=0.0), sum(weights) / math.log2(2 + words), len(weights) / words)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-(-2.0 + 0.7 * f[0] + 0.4 * f[1] + 5.0 * f[2])))), text


def test_sharding_reads_texts_once(docs):
    """What is returned reads the written places, not the texts, their windows or joins by text."""
    plan = sharding.op10_sharding(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "text#" not in plan


def test_sharding_equals_a_plain_line(spark):
    """Shards and slots against one sorted list with running sums."""
    rng = random.Random(9)
    rows = [(k, "hot" if k % 3 == 0 else f"text {rng.randrange(200)}" * rng.randint(1, 3)) for k in range(3000)]
    n, total = 24, sum(len(t) + 8 for _, t in rows)
    md5 = lambda x, d: int(hashlib.md5(str(x).encode()).hexdigest()[:d], 16)
    line = sorted((md5(t, 15), md5(k, 8) % 256, k, len(t) + 8) for k, t in rows)
    group, at, want, starts = defaultdict(int), 0, {}, {}
    for h, _, _, size in line:
        group[h] += size
    for place, (h, _, k, size) in enumerate(line):
        begin = starts.setdefault(h, at)
        middle2 = 2 * begin + group[h] if group[h] * n * 50 <= total else 2 * at + size
        want[k] = (min(middle2 * n // (2 * total), n - 1), place)
        at += size
    first = {}
    for shard, place in want.values():
        first[shard] = min(place, first.get(shard, place))
    got = sharding.op10_sharding(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == {k: (s, p - first[s]) for k, (s, p) in want.items()}


def test_unknown_vocabulary_is_refused(tmp_path):
    import json

    spec = json.loads(open(bpe.vocabulary_path(), encoding="utf-8").read())
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:1]
    with pytest.raises(ValueError, match="normalisation"):
        bpe.Vocabulary(json.dumps(spec))


def test_exceptions_spare_what_lies_inside_one_of_them():
    lex = toxicity.Lexicon({"bb": (1.0, False)}, ["aa bb", "bb cc"])
    a = lex.automaton()
    assert [lex.features(a, t)[0] for t in ("aa bb", "bb cc", "aa bb cc", "bb aa", "x bb y")] == [0, 0, 0, 1, 1]


def test_rare_language_keeps_its_trigrams(spark):
    """A cap of trigrams is each language's own."""
    rows = [(k, "alpha beta gamma delta " * 30, "aa") for k in range(60)] + [(100 + k, "ququ wawa zuzu", "zz") for k in range(3)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_grams=20)
    assert m.languages == ["aa", "zz"] and m.predict(["zuzu ququ", "beta alpha"]) == [("zz", 1.0), ("aa", 1.0)]


def test_toxicity_counts_words_between_any_separators():
    lex = toxicity.Lexicon({"idiot": (3.0, False)}, [], [-2.0, 0.5, 0.5, 20.0])
    words = ["clean"] * 400 + ["idiot"] + ["clean"] * 400
    scores = {lex.score(lex.features(lex.automaton(), sep.join(words))) for sep in (" ", "\n", "\t", "  ", "\u00a0", ", ", "-")}
    assert len(scores) == 1 and scores.pop() < 0.5


def test_texts_without_letters_have_no_language(spark):
    rows = [(k, "alpha beta gamma delta" if k % 2 else "uno dos tres cuatro", "en" if k % 2 else "es") for k in range(40)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.predict(["²", "½ 3 ①", "Ⅳ 12", "_ - 7", "² beta"]) == [("und", 0.0)] * 4 + [("en", 1.0)]


def test_many_spans_take_linear_time():
    """Added spans against all others, and the same spans as a plain test of every pair; a page with thousands is quick."""
    import time

    part = "call phone 030 1234567 or 030 7654321 token=abcd1234efgh5678ijkl a1@b.co 192.168.1.1 DE89 3704 0044 0532 0130 00 +49 30 1234567 "
    got = [s[:3] for s in pii.find_spans(part * 5)]
    taken = [s for s in got if s[0] in pii.BASE]
    assert [s for s in got if s[0] in pii.ADDED] and all(not (x < b and a < y) for k, a, b in got if k in pii.ADDED for j, x, y in got if (j, x) != (k, a)) and len(taken) == 15
    rng = random.Random(3)
    for _ in range(300):
        taken = [(a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(6))]
        spans = sorted((a, a + rng.randint(1, 9)) for a in (rng.randrange(60) for _ in range(6)))
        want = []
        for a, b in spans:
            if not any(x < b and a < y for x, y in taken + want):
                want.append((a, b))
        assert pii._free(spans, taken) == want
    began = time.process_time()
    assert len(pii.find_spans(part * 4000)) >= 20_000
    assert time.process_time() - began < 3


def test_chat_of_odd_conversations(spark):
    """Repeated rows, rows without a conversation, one very long text, and further columns whose names are used inside."""
    long = "word [INST] " * 40_000
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", long), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (2, 0, "user", ""), (2, 1, "assistant", None)]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], "conv_id long, turn int, role string, text string, turns string, n_turns int, segments string, formatted string")
    got = {r["conv_id"]: r for r in chat.op2_chat(df).collect()}
    assert set(got) == {1, 2, -1, None} and got[1]["n_turns"] == 3 and got[2]["loss_chars"] == 0
    assert got[1]["turns_sha256"] == sha("user\nhi\nuser\nhi\n" + f"assistant\n{long}\n") and got[1]["loss_chars"] == len(long) and got[1]["loss_sha256"] == sha(long)
