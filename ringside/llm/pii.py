"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score.

Base kinds (e-mail, ip, card, phone) are leftmost, non-overlapping matches of fixed patterns that pass their check: a
match that fails is dropped and never tried again from a later place. The method adds three kinds beside them: IBANs
confirmed by their country's length and mod-97 remainder, phone numbers without a leading plus that only words nearby
make likely, and secrets: values that are given to a name like ``token`` and vary as much as random ones do. A span's score
starts from its kind's certainty and moves with context words within ``CONTEXT`` characters; added spans below
``MIN_SCORE`` and added spans that touch a base span are dropped, base spans always stay.

Null texts count as empty; rows that repeat an id each get a row; ids may be null. All of a text is read, however long:
each pattern starts only at an anchor (``@``, ``+`` or the first digit of a run), and spans are kept apart by one sorted
list a kind, so that the time follows the length but for the sort of the spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.common import tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "secret")
KINDS = (*BASE, *ADDED)

# fixed values
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_START = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
SECRET = re.compile(r"(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([a-z0-9_/+=.-]{16,})")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20/-][0-9]{2,5}){1,4}(?![0-9A-Za-z-])")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
CERTAINTY = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "local_phone": 0.3, "secret": 0.8}
CONTEXT_WORDS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "movil"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "local_phone": ("phone", "tel", "telefon", "mobile", "call me", "fax"),
    "secret": ("token", "secret", "password", "key"),
}
AGAINST_WORDS = ("order", "invoice", "version", "isbn", "build", "serial")
CONTEXT, MIN_SCORE, MIN_BITS = 48, 0.5, 3.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country code and check number exactly the characters of that country."""
    for m in IBAN_START.finditer(text):
        rest = IBAN_REST.get(IBAN_LENGTHS.get(m[0][:2], 0))
        r = rest.match(text, m.end()) if rest else None
        if r and mod97(text[m.start() : r.end()].replace(" ", "")):
            yield m.start(), r.end()


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of local part, @ and dotted domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {"email": list(_emails(text)), "ip": [], "card": [], "phone": []}
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - CONTEXT) : start]} {text[end : end + CONTEXT // 2]}".lower()
    words = set(re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", near))
    value = CERTAINTY[kind]
    value += 0.3 if any(w in words if " " not in w else w in near for w in CONTEXT_WORDS[kind]) else 0.0
    value -= 0.3 if any(w in words for w in AGAINST_WORDS) else 0.0
    return min(1.0, max(0.0, value))


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of every span, by kind as in KINDS and then by start."""
    found = base_spans(text)
    extra: dict[str, list[tuple[int, int]]] = {"iban": list(_ibans(text)), "local_phone": [], "secret": []}
    low = text.lower()
    for m in SECRET.finditer(text) if any(w in low for w in ("token", "secret", "passw", "key")) else ():
        if bits(m[1]) >= MIN_BITS and any(x.isdigit() for x in m[1]) and any(x.isalpha() for x in m[1]):
            extra["secret"].append(m.span(1))
    if any(w in low for w in CONTEXT_WORDS["local_phone"]):
        for m in LOCAL_PHONE.finditer(text):
            if 7 <= len(_digits(m[0])) <= 13 and score(text, "local_phone", *m.span()) >= MIN_SCORE:
                extra["local_phone"].append(m.span())
    out = [(k, a, b, score(text, k, a, b)) for k in BASE for a, b in found[k]]
    for kind in ADDED:
        free = _free(extra[kind], [s[1:3] for s in out])
        out += [(kind, a, b, score(text, kind, a, b)) for a, b in free]
    return out


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (in order) that touch neither those taken nor an earlier one of their own."""
    merged: list[list[int]] = []  # disjoint, so that starts and ends are in order
    for a, b in sorted(taken) if spans else ():
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    ends = [b for _, b in merged]
    out: list[tuple[int, int]] = []
    for a, b in spans:
        k = bisect_left(ends, a + 1)  # the first that ends behind a
        if not (k < len(merged) and merged[k][0] < b) and not (out and a < out[-1][1]):
            out.append((a, b))
    return out


SPANS = "spans array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans of every row (offsets in code points, end exclusive)."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t or "")] for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "spans": spans})

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.mapInPandas(tidy(run), f"id {kind}, {SPANS}").withColumnRenamed("id", id_col)


def redact_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text:
        return text
    merged: list[list] = []
    for kind, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same columns, with personal data in the text replaced; nulls stay null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(redact_text, na_action="ignore")

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op6_pii(docs: DataFrame) -> DataFrame:
    found = detect(docs)
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = of(*BASE)
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in ADDED],
    )
