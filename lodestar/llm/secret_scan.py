"""Secret scan: fixed patterns, and a guess-cost estimate of values that stand in a credential context.

Base kinds, each matched from left to right without overlap: `assign` (a credential word, an assignment and a value),
`access` (access key ids), `hex` (long hexadecimal runs). A match that is too short is dropped.

The kind `guess` adds values after a wider set of credential words. A value's cost is the least sum over its
segmentations into dictionary words, dates, repeats, keyboard walks and brute-force spans of the decimal logarithm of the
guesses each part takes (dynamic programming over the value's positions; brute force is extended by one character at a
time and other parts have at most `PART` characters, so that the work is linear in the value's length). Values that cost
at least `min_cost` are reported; a cheap value is a placeholder or prose.

The dictionary has frequent passwords and, after them, the corpus's own words by their frequency in all its texts
(`learned`: a word has to occur `least` times, and the `most` most frequent ones are taken; both are parameters).

Spans are start and end in code points, end exclusive, of the whole match (of the value, for `guess`).

Defined cases: null text is empty and has no spans; repeated rows give a row each; a null id stays null; a text without
spans has the hash of the empty string; an empty table gives an empty result; texts and values may be of any length
(memory grows with the longest text); words of one frequency are ranked by name; other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import map_arrow, sub_batches, table

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is matched from its start, whole
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT_WORDS = ("passphrase", "passcode", "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "private_key", "access_key", "auth_key")
CONTEXT = re.compile(
    r"""(?:passphrase|passcode|password|passwd|pwd|secret|token|api[_-]?key|credentials?|bearer|private_key|access_key|auth_key)["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+is[ \t]+|[ \t]+)["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)

#: Frequent passwords and words, most frequent first; a word's rank is its guess count.
WORDS = (
    "password", "qwerty", "letmein", "welcome", "admin", "login", "secret", "dragon", "monkey", "master", "hello", "love",
    "football", "baseball", "princess", "sunshine", "shadow", "superman", "batman", "trustno", "iloveyou", "changeme",
    "default", "example", "test", "guest", "root", "user", "token", "pass", "summer", "winter", "spring", "autumn",
    "monday", "friday", "january", "december", "london", "paris", "berlin", "madrid", "star", "house", "water", "fire",
    "the", "and", "for", "this", "that", "with", "from", "your", "have", "will", "home", "time", "year", "good", "great",
    "first", "last", "open", "close", "start", "stop", "data", "base", "server", "cloud", "prod", "stage", "local", "main",
    "public", "private", "key", "code", "name", "mail", "phone", "money", "bank", "card", "red", "blue", "green", "black",
    "white", "king", "queen", "tiger", "eagle", "correct", "horse", "battery", "staple",
)

PART = 32  # characters of a part that is no brute force, at most; longer runs are several parts
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$57!", "aaeiosstl")

DATE = re.compile(r"(?:(?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-/._](?:1[0-2]|0?[1-9])[-/._](?:(?:19|20)?\d\d)|(?:19|20)\d\d)")


@lru_cache(maxsize=1)
def _adjacent() -> set[tuple[str, str]]:
    out = set()
    for r, row in enumerate(ROWS):
        for i, c in enumerate(row):
            for r2, i2 in ((r, i + 1), (r + 1, i), (r + 1, i - 1)):
                if r2 < len(ROWS) and 0 <= i2 < len(ROWS[r2]):
                    out |= {(c, ROWS[r2][i2]), (ROWS[r2][i2], c)}
    return out


#: The rank of each word, from 1, and the length of the longest.
Ranks = tuple[dict[str, int], int]


def ranked(words: tuple[str, ...]) -> Ranks:
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}, min(PART, max(map(len, words), default=0))


@lru_cache(maxsize=1)
def _plain() -> Ranks:
    return ranked(WORDS)


def learned(df: DataFrame, *, text_col: str = "text", most: int = 10_000, least: int = 20) -> tuple[str, ...]:
    """WORDS, and then the most frequent words of all texts: runs of 3 to 24 letters a-z, in lower case."""
    found = df.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("w")).where("length(w) between 3 and 24")
    found = found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "w").limit(most)
    known = set(WORDS)
    return (*WORDS, *(r[0] for r in found.collect() if r[0] not in known))


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000


def guess_cost(value: str, ranks: Ranks | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; 0 for an empty value."""
    return _cheapest(value, ranks or _plain())[0]


def segments(value: str, ranks: Ranks | None = None) -> list[tuple[str, int, int]]:
    """The cheapest segmentation: (kind, start, end) of each part."""
    return _cheapest(value, ranks or _plain())[1]


def _dates(value: str) -> dict[int, list[tuple[str, int, float]]]:
    """For each end, the dates that end there."""
    out: dict[int, list[tuple[str, int, float]]] = {}
    digit = [c in "0123456789" for c in value]
    for i in range(len(value) - 3):
        if digit[i]:
            for j in range(i + 4, min(len(value), i + 10) + 1):
                if digit[j - 1] and DATE.fullmatch(value, i, j):
                    out.setdefault(j, []).append(("date", i, math.log10(365 * 120) if j - i > 4 else 2.1))
    return out


def walk_cost(n: int) -> float:
    return math.log10(47 * 4 ** min(3, n // 3) * n)


def repeat_cost(c: str, n: int) -> float:
    return math.log10(_class_size(c) * n)


def _cheapest(value: str, ranks: Ranks) -> tuple[float, list[tuple[str, int, int]]]:
    rank, longest = ranks
    n, low = len(value), "".join(c.lower() if c.isascii() else c for c in value)
    plain = low.translate(LEET)
    part = math.log10(2)  # a guesser has to try where parts end
    # best[i]: cheapest cost of value[:i]; brute: the same if its last part is a brute-force span from brute_from on.
    best, brute, brute_from = [0.0] + [math.inf] * n, math.inf, 0
    back: list[tuple[str, int]] = [("", 0)] * (n + 1)
    dates = _dates(value)
    walk = repeat = 0  # where the runs that end at i - 1 began
    near = _adjacent()
    for i in range(1, n + 1):
        c = value[i - 1]
        if best[i - 1] + part <= brute:
            brute, brute_from = best[i - 1] + part, i - 1
        brute += math.log10(_class_size(c))
        found = list(dates.get(i, ()))
        if i > 1:
            walk = walk if (low[i - 2], low[i - 1]) in near else i - 1
            repeat = repeat if low[i - 2] == low[i - 1] else i - 1
        found += [("walk", j, walk_cost(i - j)) for j in range(max(walk, i - PART), i - 2)]
        found += [("repeat", j, repeat_cost(low[j], i - j)) for j in range(max(repeat, i - PART), i - 2)]
        for j in range(max(0, i - longest), i - 2):
            for text, extra in ((low, 0.0), (plain, 0.3)):
                if r := rank.get(text[j:i]):
                    found.append(("word", j, math.log10(r + 1) + extra + (0.0 if value[j:i] == text[j:i] else 0.3)))
        best[i], back[i] = brute, ("brute", brute_from)
        for kind, j, cost in found:
            if best[j] + cost + part < best[i]:
                best[i], back[i] = best[j] + cost + part, (kind, j)
    out, i = [], n
    while i:
        kind, j = back[i]
        out.append((kind, j, i))
        i = j
    return best[n], out[::-1]


def find(text: str, *, min_cost: float = 9.0, ranks: Ranks | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start, then kind as listed."""
    low = text.lower() if text.isascii() else None
    has = (lambda ws: any(w in low for w in ws)) if low is not None else (lambda ws: True)
    out = []
    if has(ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if has(CONTEXT_WORDS):
        out += [("guess", *m.span(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks) >= min_cost]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_cost: float = 9.0, words: tuple[str, ...] = WORDS) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranked(words)
        for batch in sub_batches(batches, "text", 1 << 22):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(x or "", min_cost=min_cost, ranks=ranks)] for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def _is(kind: str):
    return lambda x: x == kind


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, words=learned(docs))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.filter("spans", lambda s: s.kind != "guess")
    n = [F.size(F.filter(F.transform("spans", lambda s: s.kind), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n[:3], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), n[3])
