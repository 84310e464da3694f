"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding maps upper case, accents, full-width forms, look-alike letters and digits that stand for letters to plain
letters, and drops invisible characters. The lexicon is a small fixed list plus terms learned from labelled rows: whole
words and word beginnings, each weighted by its log-odds of standing in a toxic document. Fixed exception phrases and
learned ones (a term with a neighbour that clean documents show often and toxic ones never) cancel the matches inside
them. A document's features are its strongest match, its summed weights over the logarithm of its length, and its
matches per word (a run of letters and digits); a logistic model gives the score, set to the share of toxic rows among all labelled ones.

At most about ``max_per_class`` labelled documents of each class are read for training (a hashed share); what is learned
grows with these and with nothing else. Prediction reads all of every text. Null and empty texts get the score of no
match. Rows that repeat an id are scored each by its own text and train each; an id with several labels is toxic if one
says so; a null id isn't held out. Without labels of both classes the fixed list alone decides.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import tidy
from ringside.llm.langid import held_out

# fixed values
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "jerk", "dumbass", "vermin", "bastard", "asshole", "bitch", "retard")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "circus clown", "sore loser", "idiot proof", "trash collection")
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɑ": "a", "ɡ": "g", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
BETWEEN = {"@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
SAME = {"l": "i"}  # 1 stands for both


def _fold_table() -> dict[int, str | None]:
    def plain(c: str) -> str:
        base = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        base = "".join(LOOKALIKES.get(x, x) for x in base)
        return "".join(SAME.get(x, x) for x in base)

    table: dict[int, str | None] = {}
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x52F), (0x1E00, 0x1EFF), (0xFF10, 0xFF5A), (0x251, 0x261)):
        for x in range(a, b + 1):
            if (got := plain(chr(x))) != chr(x):
                table[x] = got
    table |= {ord(k): plain(v) for k, v in DIGITS.items()}
    table |= {x: None for x in (*INVISIBLE, *range(0x300, 0x370))}
    return table


FOLD = _fold_table()
INNER = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    if any(c in text for c in BETWEEN):
        text = INNER.sub(lambda m: BETWEEN[m[0]], text)
    return text.translate(FOLD)


@dataclass
class Lexicon:
    terms: dict[str, tuple[float, bool]]  # folded term: weight, is a word beginning
    exceptions: list[str]
    coefficients: list[float] = field(default_factory=lambda: [-3.0, 1.0, 0.0, 0.0])

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, (weight, beginning) in self.terms.items():
            a.add_word(term, (len(term), weight, beginning))
        for phrase in self.exceptions:
            if phrase not in self.terms:
                a.add_word(phrase, (len(phrase), None, False))
        if len(a):
            a.make_automaton()
        return a

    def features(self, automaton, text: str) -> tuple[float, float, float]:
        folded = fold(text)
        hits: list[tuple[int, int, float]] = []
        spared: list[tuple[int, int]] = []
        if len(automaton):
            for end, (size, weight, beginning) in automaton.iter(folded):
                start = end - size + 1
                if start and folded[start - 1].isalnum() or not beginning and end + 1 < len(folded) and folded[end + 1].isalnum():
                    continue
                if weight is None:
                    spared.append((start, end))
                else:
                    hits.append((start, end, weight))
        if spared and hits:
            spared.sort()
            starts = [a for a, _ in spared]
            furthest = list(accumulate((b for _, b in spared), max))  # an exception that starts no later and ends there
            inside = lambda h: (k := bisect_right(starts, h[0])) > 0 and furthest[k - 1] >= h[1]
            hits = [h for h in hits if not inside(h)]
        at: dict[int, float] = {}  # the strongest match at each place
        for start, _, weight in hits:
            at[start] = max(weight, at.get(start, -math.inf))
        weights = [w for w in at.values() if w > 0]
        if not weights:
            return 0.0, 0.0, 0.0
        words = sum(1 for _ in WORD.finditer(folded))  # runs of letters and digits, whatever lies between them
        return max(weights), sum(weights) / math.log2(2 + words), len(weights) / words

    def score(self, f: tuple[float, float, float]) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], f, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms_of(text: str) -> set[str]:
    """Words (marked by a final $) and word beginnings of four to eight letters."""
    out = set()
    for w in set(WORD.findall(fold(text))):
        out.add(w + "$")
        out.update(w[:k] for k in range(4, min(9, len(w) + 1)))
    return out


def _fit(x: np.ndarray, y: np.ndarray, prior: float) -> list[float]:
    """Logistic regression with a small ridge, then the intercept moved to the prior of class 1."""
    if len(x) == 0 or y.min() == y.max():
        return [-3.0, 1.0, 0.0, 0.0]
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack([np.ones(len(x)), x / scale])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [0.05] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p) + 1e-9)[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    w[0] += math.log(prior / (1 - prior)) - math.log(share / (1 - share))
    return [float(w[0]), *map(float, w[1:] / scale)]


LEAST_TOXIC, LEAST_WEIGHT, RARE = 3, 2.0, 0.2


def choose_terms(counts: list, n: tuple[int, int]) -> dict[str, tuple[float, bool]]:
    """Weights from (term, toxic, clean) counts over n = (clean, toxic) documents; a term that begins with a chosen
    word beginning of no smaller weight is left out."""
    log_odds = lambda tox, clean: math.log((tox + RARE) / (n[1] + 1)) - math.log((clean + RARE) / (n[0] + 1))
    known = {t: (tox, clean) for t, tox, clean in counts}
    out: dict[str, tuple[float, bool]] = {}
    for word in LEXICON:
        w = fold(word)
        tox, clean = known.get(w + "$", (0, 0))
        out[w] = (max(0.0, log_odds(tox + 2, clean)) if n[1] else 3.0, False)
    ranked = sorted(((log_odds(tox, clean) * math.sqrt(tox), t, tox, clean) for t, (tox, clean) in known.items()), key=lambda r: (-r[0], len(r[1]), r[1]))
    for _, t, tox, clean in ranked:
        weight, beginning = log_odds(tox, clean), not t.endswith("$")
        term = t.rstrip("$")
        if tox < LEAST_TOXIC or weight < LEAST_WEIGHT or term in out:
            continue
        if any(out.get(term[:k], (0, False))[1] for k in range(4, min(9, len(term)))):
            continue
        out[term] = (weight, beginning)
    return out


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = 8_000) -> Lexicon:
    """Learn from the rows of ``labels`` (doc_id, toxic) given here; hold rows out before the call."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, max_per_class / max(size.get(k, 0), 1)) for k in (0, 1)}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000))
    # about 2 * max_per_class rows of two columns
    sample = known.filter(drawn < F.when(F.col("toxic") == 1, int(share[1] * 1e6)).otherwise(int(share[0] * 1e6)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("toxic", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                n[toxic].update(_terms_of(text))
        yield pd.DataFrame([(t, n[1][t], n[0][t]) for t in set(n[0]) | set(n[1])], columns=["term", "toxic", "clean"])

    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (total.get(0, 0), total.get(1, 0))
    # only terms that can be chosen, or have a fixed entry, reach the driver
    odds = F.ln((F.col("toxic") + RARE) / (n[1] + 1)) - F.ln((F.col("clean") + RARE) / (n[0] + 1))
    telling = (F.col("toxic") >= LEAST_TOXIC) & (odds >= LEAST_WEIGHT - 1e-6)
    counts = (
        rows.mapInPandas(tidy(count), "term string, toxic long, clean long")
        .groupBy("term")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(telling | F.col("term").isin(*[fold(w) + "$" for w in LEXICON]))
    )
    terms = choose_terms([(r["term"], r["toxic"], r["clean"]) for r in counts.collect()], n)
    lexicon = Lexicon(terms, [fold(x) for x in EXCEPTIONS])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Features, and neighbours of matches as candidates for exceptions."""
        lex = shared.value
        automaton = lex.automaton()
        for b in batches:
            out = []
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                f = lex.features(automaton, text)
                out.append((toxic, *f, sorted(_phrases(lex, text)) if f[0] > 0 else []))
            yield pd.DataFrame(out, columns=["toxic", "a", "b", "c", "phrases"])

    seen = rows.mapInPandas(tidy(second), "toxic int, a double, b double, c double, phrases array<string>").persist()
    phrases = (
        seen.select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase")
        .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).filter("toxic = 0 and n >= 3").orderBy("phrase").collect()
    )
    points = seen.select("toxic", "a", "b", "c").toPandas()  # about 2 * max_per_class rows of numbers
    seen.unpersist()
    everything = max(1, sum(size.values()))
    prior = min(0.9, max(0.01, size.get(1, 0) / everything))
    fitted = _fit(points[["a", "b", "c"]].to_numpy(), points["toxic"].to_numpy().astype(float), prior)
    return Lexicon(terms, lexicon.exceptions + [r["phrase"] for r in phrases], fitted)


def _phrases(lex: Lexicon, text: str) -> set[str]:
    words = WORD.findall(fold(text))
    out = set()
    for k, w in enumerate(words):
        if w in lex.terms or any(lex.terms.get(w[:j], (0, False))[1] for j in range(4, min(9, len(w) + 1))):
            if k:
                out.add(f"{words[k - 1]} {w}")
            if k + 1 < len(words):
                out.add(f"{w} {words[k + 1]}")
    return out


def score_texts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by what max_per_class documents hold

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shared.value
        automaton = lex.automaton()
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "score": [lex.score(lex.features(automaton, t)) for t in b["text"]]})

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInPandas(tidy(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def text_score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> Column:
    """The score as a column, for filters that keep all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = shared.value
        automaton = lex.automaton()
        for texts in batches:
            yield pd.Series([lex.score(lex.features(automaton, t)) for t in texts], dtype=float)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    return scored(F.coalesce(F.col(text_col), F.lit("")))


def op4_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    lexicon = train(docs, labels.filter(~held_out()))
    scored = score_texts(docs, lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
