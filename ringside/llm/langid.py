"""Language of a text: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts character trigrams of words for each language in labelled rows; at most about ``max_train`` documents
are read for it (a hashed share of the labelled rows, so that the bound holds at any size). Prediction cuts a text
into words; the scripts of a word's letters leave only the languages learned with that script, trigrams score them,
and Viterbi over the words with a penalty for every switch labels spans. The language with most letters wins; the
score is its share of the letters.

Null texts and texts without letters are ``und`` with score 0. Words in a script that no language has are scored
alike for all. All of a text is read. Ties go to the language that sorts first. Rows that repeat an id are predicted
each by its own text; a null id isn't held out. Languages keep their ``max_grams`` commonest trigrams each, so that a
rare language keeps as many as a common one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringside.llm.common import tidy

WORD = regex.compile(r"\p{L}+")
UNKNOWN = "und"
# fixed values: code point ranges of scripts; letters outside all of them are "other"
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x4E00, 0x9FFF), (0x3400, 0x4DBF)),
}
CACHE_BYTES, BATCH_WORDS = 40_000_000, 1_000_000


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def scripts_of(word: str) -> set[str]:
    if word.isascii():
        return {"latin"}
    out = set()
    for c in set(word):
        x = ord(c)
        out.add(next((s for s, ranges in SCRIPTS.items() if any(a <= x <= b for a, b in ranges)), "other"))
    return out


def trigrams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[k : k + 3] for k in range(len(w) - 2)]


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # trigrams x languages, the last row for trigrams not seen
    places: dict[str, int]
    scripts: dict[str, np.ndarray]  # for each script: the languages learned with it
    penalty: float

    def __post_init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.bytes = 0
        self.rows = np.zeros((0, len(self.languages)), dtype=np.float32)

    def score_words(self, words: list[str]) -> np.ndarray:
        """words x languages: log-likelihood relative to the best, at least -8; candidates by script."""
        grams = [trigrams(w) for w in words]
        sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
        last = len(self.places)
        at = np.fromiter((self.places.get(g, last) for gs in grams for g in gs), dtype=np.int64, count=int(sizes.sum()))
        total = np.add.reduceat(self.log_p[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        of: dict[frozenset[str], list[int]] = {}
        for k, w in enumerate(words):
            of.setdefault(frozenset(scripts_of(w)), []).append(k)
        for scripts, rows in of.items():
            fits = np.zeros(len(self.languages), dtype=bool)
            for s in scripts:
                fits |= self.scripts.get(s, fits)
            if not fits.any():
                total[rows] = 0
            elif not fits.all():
                total[np.ix_(rows, np.flatnonzero(~fits))] = -np.inf
        return np.maximum(total - total.max(axis=1, keepdims=True), -8).astype(np.float32)

    def lookup(self, words: list[str]) -> np.ndarray:
        """Place of each word in rows."""
        new = [w for w in dict.fromkeys(words) if w not in self.seen]
        if new and self.bytes > CACHE_BYTES:
            self.seen, self.rows, self.bytes = {}, np.zeros((0, len(self.languages)), dtype=np.float32), 0
            new = list(dict.fromkeys(words))
        if new:
            self.bytes += sum(map(len, new)) + len(new) * (150 + 4 * len(self.languages))
            self.seen |= {w: len(self.rows) + k for k, w in enumerate(new)}
            self.rows = np.concatenate([self.rows, self.score_words(new)])
        return np.fromiter(map(self.seen.__getitem__, words), dtype=np.int64, count=len(words))

    def spans(self, words_of: list[list[str]]) -> list[np.ndarray]:
        """Language (place) of every word of every text: Viterbi, all texts of the batch one step at a time."""
        sizes = np.fromiter(map(len, words_of), dtype=np.int64, count=len(words_of))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        n = sizes[order]
        starts = np.concatenate([[0], np.cumsum(sizes)])[order]
        if not len(order):
            return [np.zeros(0, dtype=np.int8) for _ in words_of]
        places = self.lookup([w for ws in words_of for w in ws])
        s = self.rows[places]
        active = np.searchsorted(-n, -np.arange(n[0]), side="left")  # texts with more than t words
        v = s[starts].copy()
        best = np.zeros(len(s), dtype=np.int8)
        came = np.zeros(s.shape, dtype=bool)  # True: switched to this language from the best one
        for t in range(1, int(n[0])):
            k = active[t]
            at, now = starts[:k] + t, v[:k]
            top = now.argmax(axis=1)
            jump = now[np.arange(k), top][:, None] - self.penalty
            best[at] = top
            came[at] = jump > now
            v[:k] = np.maximum(now, jump) + s[at]
        path = np.zeros(len(s), dtype=np.int8)
        state = v.argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            k = active[t]
            at, now = starts[:k] + t, state[:k]
            path[at] = now
            if t:
                state[:k] = np.where(came[at, now], best[at], now)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        return [path[cut[k] : cut[k + 1]] for k in range(len(words_of))]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words_of = [WORD.findall(t.lower()) for t in texts]
        out = []
        for words, path in zip(words_of, self.spans(words_of), strict=True):
            if not words or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            letters = np.bincount(path, weights=np.fromiter(map(len, words), dtype=np.float64, count=len(words)), minlength=len(self.languages))
            k = int(letters.argmax())
            out.append((self.languages[k], float(letters[k] / letters.sum())))
        return out


def train(rows: DataFrame, max_train: int = 12_000, max_grams: int = 20_000, penalty: float = 6.0) -> Model:
    """Learn from rows (doc_id, text, lang); ``max_grams`` is for each language."""
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    share = min(1.0, max_train / max(n, 1))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: Counter = Counter()
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                for w, k in Counter(WORD.findall(text.lower())).items():
                    for g in trigrams(w):
                        grams[lang, g] += k
                    for s in scripts_of(w):
                        grams[lang, f"script {s}"] += k * len(w)
        yield pd.DataFrame([(a, g, k) for (a, g), k in grams.items()], columns=["lang", "gram", "n"])

    counts = sample.mapInPandas(tidy(count), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang", F.col("gram").startswith("script ")).orderBy(F.desc("n"), "gram"))
    return build(counts.withColumn("place", place).filter(F.col("place") <= max_grams).collect(), penalty)


def build(counts: list, penalty: float) -> Model:
    languages = sorted({r["lang"] for r in counts})
    place = {x: k for k, x in enumerate(languages)}
    grams = sorted({r["gram"] for r in counts if not r["gram"].startswith("script ")})
    places = {g: k for k, g in enumerate(grams)}
    n = np.full((len(grams) + 1, len(languages)), 0.5)
    scripts: dict[str, np.ndarray] = {}
    letters = Counter()
    for r in counts:
        if r["gram"].startswith("script "):
            letters[r["lang"]] += r["n"]
        else:
            n[places[r["gram"]], place[r["lang"]]] += r["n"]
    for r in counts:
        if r["gram"].startswith("script ") and r["n"] >= 0.01 * letters[r["lang"]]:
            scripts.setdefault(r["gram"][7:], np.zeros(len(languages), dtype=bool))[place[r["lang"]]] = True
    log_p = np.log(n / n.sum(axis=0)).astype(np.float32) if languages else np.zeros((1, 0), dtype=np.float32)
    return Model(languages, log_p, places, scripts, penalty)


def _runs(texts: list[str], words: int = BATCH_WORDS) -> Iterator[slice]:
    """Slices of a batch of about so many words (counted as characters / 6)."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= 6 * words:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_grams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts = b["text"].tolist()
            got = [x for s in _runs(texts) for x in m.predict(texts[s])]
            yield pd.DataFrame({"id": b["id"], "lang_pred": [x[0] for x in got], "score": [x[1] for x in got]})

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInPandas(tidy(run), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op3_langid(docs: DataFrame) -> DataFrame:
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
