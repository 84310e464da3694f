"""Byte-pair encoding by speculation and verification, and decoding.

A text is cut into words (special tokens first, then normalisation and the word pattern); a vocabulary file that asks
for another normalisation, pattern or decoder than the one written here is refused.
For every word that a task hasn't met yet, greedy longest match proposes tokens. A sequence of tokens is the
encoding of its text exactly when every two neighbours are: so all neighbouring pairs of all new words are tested at
once, on arrays, by undoing merges from the latest backwards and looking for an earlier merge across the border. Only
words with a failing pair are merged exactly, by rank.

Null and empty texts have no tokens; rows that repeat an id or a text each get a row. Memory: the vocabulary, which
leaves a worker with the stage that needs it, a cache of at most twice ``CACHE_BYTES`` that leaves with the task, and the words
of about ``CHUNK`` characters (of one text, if it is longer). A single long word costs n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.llm.common import tidy

CACHE_BYTES, CACHE_CHARS, CHUNK, SHORT = 60_000_000, 48, 1_000_000, 32
SPACE = r"\t-\r \x85\xa0  -     　"  # fixed values: Unicode white space
NO_LIMIT = np.iinfo(np.int64).max
# fixed values: what this module does, in the words of a vocabulary file
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def supported(data: dict) -> bool:
    model = data["model"]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) and model["type"] == "BPE"
    special = all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in data["added_tokens"])
    cut = (data["normalizer"] or {}).get("normalizers") == NORMALISED and (data["pre_tokenizer"] or {}).get("pretokenizers") == SPLIT
    return plain and special and cut and data["decoder"] is None and bool(model.get("end_of_word_suffix"))


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next character from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tokens in order of creation: single bytes first, then one token a merge."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        if not supported(data):
            raise ValueError("the vocabulary file asks for another normalisation, word pattern, decoder or kind of model")
        vocab, suffix = data["model"]["vocab"], data["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        made = {a + b: k for k, (a, b) in enumerate(merges)}
        base = [t for t in vocab if t not in made]
        names = base + [a + b for a, b in merges]
        place = {t: k for k, t in enumerate(names)}
        self.suffix, self.names = suffix, names
        self.ids = np.array([vocab[t] for t in names], dtype=np.int64)
        self.inner = {t: k for t, k in place.items() if not t.endswith(suffix)}
        self.final = {t[: len(t) - len(suffix)]: k for t, k in place.items() if t.endswith(suffix)}
        self.reach: dict[str, int] = {}  # the longest token that begins with these two characters (or is this one)
        for table in (self.inner, self.final):
            for t in table:
                self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.id_text = [str(vocab[t]) for t in names]
        left, right = np.arange(len(names)), np.arange(len(names))
        for k, (a, b) in enumerate(merges, len(base)):
            left[k], right[k] = place[a], place[b]
        self.left, self.right, n = left, right, len(names)
        codes = np.array([place[a] * n + place[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.joined = codes[order], np.arange(len(base), n)[order]
        self.merge = {(place[a], place[b]): k for k, (a, b) in enumerate(merges, len(base))}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.by_id = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.word = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.byte = _byte_chars()

    def words(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.word.findall(text.replace("Σ", "σ").lower())

    def spell(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join(map(self.byte.__getitem__, word.encode()))

    def propose(self, spelled: str) -> list[int]:
        out, at, n, inner, final, reach = [], 0, len(spelled), self.inner.get, self.final.get, self.reach.get
        while at < n:
            end = min(n, at + reach(spelled[at : at + 2], 1))
            while True:
                piece = spelled[at:end]
                got = final(piece) if end == n else inner(piece)
                if got is not None:
                    break
                end -= 1
            out.append(got)
            at = end
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair: would byte-pair merging leave exactly these two tokens?"""
        n = len(self.names)
        good = np.ones(len(first), dtype=bool)
        rows = np.arange(len(first))
        a, b, limit = first.copy(), second.copy(), np.full(len(first), NO_LIMIT)
        while len(rows):
            code = a * n + b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            bad = (self.codes[at] == code) & (self.joined[at] < limit)
            good[rows[bad]] = False
            a_splits, b_splits = self.left[a] != a, self.left[b] != b
            undo_a = a_splits & ((a > b) | ~b_splits)
            undo_b = b_splits & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = (undo_a | undo_b) & ~bad
            rows, a, b, limit = rows[go], a[go], b[go], limit[go]
        return good

    def exact(self, spelled: str) -> list[int]:
        """Merge by rank, leftmost first."""
        tokens = [self.inner[c] for c in spelled[:-1]] + [self.final[spelled[-1]]]
        n = len(tokens)
        if n <= SHORT:
            return self._exact_short(tokens)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(k, i) for i in range(n - 1) if (k := self.merge.get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i] if tokens[i] >= 0 else -1
            if j < 0 or self.merge.get((tokens[i], tokens[j])) != k:
                continue
            tokens[i], tokens[j], after[i] = k, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := self.merge.get((tokens[x], tokens[y]))) is not None:
                    heapq.heappush(heap, (m, x))
        return [t for t in tokens if t >= 0]

    def _exact_short(self, tokens: list[int]) -> list[int]:
        """The same for few tokens: look for the least rank each time."""
        merge = self.merge.get
        ranks = [merge(pair, NO_LIMIT) for pair in zip(tokens, tokens[1:], strict=False)]
        while ranks and (best := min(ranks)) != NO_LIMIT:
            i = ranks.index(best)
            tokens[i : i + 2] = [best]
            del ranks[i]
            if i:
                ranks[i - 1] = merge((tokens[i - 1], best), NO_LIMIT)
            if i < len(ranks):
                ranks[i] = merge((best, tokens[i + 1]), NO_LIMIT)
        return tokens

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens (by order of creation) of each word."""
        spelled = [self.spell(w) for w in words]
        guess = [self.propose(s) for s in spelled]
        sizes = np.fromiter(map(len, guess), dtype=np.int64, count=len(guess))
        flat = np.fromiter((t for g in guess for t in g), dtype=np.int64, count=int(sizes.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(guess)), sizes)
            same = owner[:-1] == owner[1:]
            pairs, inverse = np.unique(flat[:-1][same] * len(self.names) + flat[1:][same], return_inverse=True)
            good = self.compatible(pairs // len(self.names), pairs % len(self.names))[inverse]
            for k in np.unique(owner[:-1][same][~good]).tolist():
                guess[k] = self.exact(spelled[k])
        return guess

    def parts(self, text: str) -> list[list[str] | str]:
        """Lists of words, and special tokens between them."""
        if not any(s in text for s in self.special):
            return [self.words(text)]
        cut = self.at_special.split(text)
        return [x if k % 2 else self.words(x) for k, x in enumerate(cut)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file has no decoder: token strings joined by spaces."""
        return " ".join(self.by_id[i] for i in ids if i in self.by_id)


class Encoder:
    """Encodes the texts of one task: a vocabulary, and the words met so far."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.seen, self.before, self.bytes = vocabulary, {}, {}, 0

    def learn(self, words: set[str]) -> dict[str, tuple[str, int, str]]:
        """(ids, their number, token strings) of each word. Short words are kept for later texts in two generations: when
        the newer one is full, the older goes, and what is met again moves to the newer."""
        out, new, again = {}, [], []
        seen, before = self.seen, self.before
        for w in words:
            x = seen.get(w)
            if x is None:
                x = before.get(w)
                if x is None:
                    new.append(w)
                    continue
                again.append((w, x))
            out[w] = x
        ids, names = self.v.id_text, self.v.names
        for w, tokens in zip(new, self.v.encode_words(new), strict=True):
            out[w] = x = (" ".join([ids[t] for t in tokens]), len(tokens), " ".join([names[t] for t in tokens]))
            if len(w) <= CACHE_CHARS:
                again.append((w, x))
        for w, x in again:
            self.bytes += 330 + len(w) + len(x[0]) + len(x[2])  # with what the objects themselves take
            if self.bytes > CACHE_BYTES:
                self.before, self.seen, self.bytes = self.seen, {}, 0
            self.seen[w] = x
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text: decimal ids joined by spaces, their number, and the decoded text."""
        parts = [self.v.parts(t) for t in texts]
        known = self.learn(set().union(*[x for p in parts for x in p if isinstance(x, list)]))
        for k, p in enumerate(parts):
            got = []
            for x in p:
                got += [(str(self.v.special[x]), 1, x)] if isinstance(x, str) else map(known.__getitem__, x)
            parts[k] = None
            yield " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _shared(docs: DataFrame, path: str | None):
    """The vocabulary as a broadcast of some MB; its size is that of the file, which the driver has read."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(Vocabulary(f.read()))


def _chunks(texts: list[str], chars: int = CHUNK) -> Iterator[list[str]]:
    """Runs of texts of about so many characters, so that memory follows characters and not rows."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, keep: list[str], path: str | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, n_tokens and the token ids of each text. Rows leave a task in small frames, so that memory
    follows the characters of a chunk and not the rows of a batch."""
    shared = _shared(docs, path)
    schema = T.StructType([docs.schema[x] for x in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for b in batches:
            texts, at = b["_text"].tolist(), 0
            rest = b[keep]
            del b
            for c in _chunks(texts):
                ids = [np.fromstring(x, dtype=np.int32, sep=" ") for x, _, _ in encoder.texts(c)]
                yield rest.iloc[at : at + len(c)].assign(n_tokens=[len(x) for x in ids], ids=ids)
                at += len(c)

    narrow = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return narrow.mapInPandas(tidy(run), schema)


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    shared = _shared(rows, path)

    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        v = shared.value
        return pd.Series([v.decode([] if x is None else list(x)) for x in ids], dtype=object)

    return rows.withColumn(out, run(F.col(ids_col)))


def op9_bpe(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of ids and decoded text, computed batch by batch where the encoding is made."""
    shared = _shared(docs, path)
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(shared.value)
        for b in batches:
            rows = [(n, sha(ids), sha(text)) for c in _chunks(b["text"].tolist()) for ids, n, text in encoder.texts(c)]
            n, ids, text = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": text})

    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return narrow.mapInPandas(tidy(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
