"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of labelled text knows every substring of it. A text is parsed
against it from left to right into phrases, each the longest match at its place (one symbol where nothing matches).
With c phrases over m symbols and a sample of n symbols, c * log2(n) / m bits a symbol would describe the text; the
language with the least wins, a tie goes to the first by name.

Symbols are letters in lower case; a run of anything else is one separator. A text is parsed in blocks of fixed length
whose phrases are summed, so that very long texts run beside others; every symbol of the text counts.

The sample: at most `sample_docs` labelled documents a language in expectation, chosen by a hash of the id, and of these
in hash order the first `sample_chars` characters together. Both are parameters; nothing else is sampled.

Defined cases: null text, or text without a letter, gives `und` with score 0, as does every text when no row is labelled.
With one language, the score is 1. Repeated rows give a row each; a null id is never learned from and is not held out. An
empty table gives an empty result. Texts may be of any length (memory grows with the longest). Other columns pass through,
whatever their names, but for those that are added.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import hold, map_arrow, sub_batches, table

UND = "und"
ADDED = ("lang_pred", "score", "bits")
SEPARATOR, UNSEEN = 0, 1


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = 64, sample_chars: int = 24_000) -> dict[str, str]:
    """Labelled text for each language, as described above. Rows that are held out are not read."""
    rows = df.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col).alias("l")).agg(F.count(F.lit(1))).collect()}
    if not counts:
        return {}
    mod, at_most = 1 << 30, F.lit(0)
    for lang, n in sorted(counts.items()):
        at_most = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, sample_docs / n) * mod))).otherwise(at_most)
    key = F.xxhash64(F.col(id_col).cast("long"))
    chosen = rows.where(F.pmod(key, F.lit(mod)) < at_most).select(F.col(lang_col).alias("lang"), key.alias("key"), F.substring(text_col, 1, sample_chars).alias("text"))
    out: dict[str, str] = {}
    for lang, _, text in sorted(map(tuple, chosen.collect())):
        out[lang] = (out.get(lang, "") + "\n" + text)[: sample_chars + 1]
    return {k: v for k, v in sorted(out.items()) if any(map(str.isalpha, v))}


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower case code point if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low[0]) if low[0].isalpha() else cp
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _collapsed(codes: np.ndarray) -> np.ndarray:
    """Which symbols stay when runs of separators become one."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SEPARATOR) | (codes[:-1] != SEPARATOR)
    return keep


class Automaton:
    """The suffix automaton of codes (numbers below width), for parsing many texts at a time.

    Edges of all states share one row: the edge of state s by symbol c is at base[s] + c, if owner there is s, so that memory
    grows with the edges and not with the alphabet. `to` has twice the next state. Where a state has no edge a new phrase
    begins: `restart`, by symbol, has twice the state after its first symbol, plus 1."""

    def __init__(self, codes: list[int], width: int):
        nexts = _suffix_automaton(codes)
        # No match is under way at the root: each edge there begins a phrase.
        self.restart = np.ones(width, np.int32)
        for c, t in nexts[0].items():
            self.restart[c] = 2 * t + 1
        self.base = np.zeros(len(nexts), np.int32)
        spots = _placed([sorted(d) for d in nexts[1:]], width)
        self.base[1:] = spots
        size = int(self.base.max()) + width
        self.owner, self.to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        for s, d in enumerate(nexts[1:], 1):
            for c, t in d.items():
                self.owner[self.base[s] + c] = s
                self.to[self.base[s] + c] = 2 * t

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """For each text, twice its next state, plus 1 if the symbol begins a phrase."""
        at = self.base[states] + symbols
        return np.where(self.owner[at] == states, self.to[at], self.restart[symbols]) if len(states) else states


def _suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The edges of each state; state 0 is the root."""
    link, length, nexts, last = [-1], [0], [{}], 0
    for c in codes:
        cur = len(nexts)
        length.append(length[last] + 1)
        nexts.append({})
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nexts)
                length.append(length[p] + 1)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nexts


def _placed(rows: list[list[int]], width: int) -> list[int]:
    """An offset for each row of symbols, so that no two rows want one place: those with most symbols first, each where
    it fits; those with one symbol fill the holes."""
    out = [0] * len(rows)
    used = bytearray(width + sum(map(len, rows)) * 2 + width)
    low = width  # below, no place is free for rows of several symbols
    for i in sorted(range(len(rows)), key=lambda i: -len(rows[i])):
        row = rows[i]
        if len(row) < 2:
            break
        at, tried = low, 0
        while True:
            at = used.find(0, at)
            if at < 0 or at + width >= len(used):
                used.extend(bytes(len(used)))
                at = max(at, low)
                continue
            base = at - row[0]
            if not any(used[base + c] for c in row):
                break
            at, tried = at + 1, tried + 1
        for c in row:
            used[base + c] = 1
        out[i] = base
        if tried > 64:
            low += (at - low) // 2
    at = width
    for i, row in enumerate(rows):
        if len(row) == 1:
            at = used.find(0, at)
            if at < 0:
                at = len(used)
                used.extend(bytes(len(used)))
            used[at] = 1
            out[i] = at - row[0]
    return out


class Parser:
    """Phrase counts of many texts against each language."""

    def __init__(self, texts: dict[str, str], block: int = 1024):
        self.langs, self.block = list(texts), block
        own = {k: _letters()[_points(v)] for k, v in texts.items()}
        alphabet = np.unique(np.concatenate([*own.values(), np.zeros(1, np.uint32)]))
        alphabet = alphabet[alphabet > 0]
        self.width = len(alphabet) + 2
        number = np.zeros(0x110000, np.uint16)
        number[alphabet] = np.arange(2, self.width)
        self.code = number[_letters()]
        self.code[(_letters() > 0) & (self.code == 0)] = UNSEEN
        self.tables, self.bits = [], []
        for v in texts.values():
            codes = self.code[_points(v)]
            codes = codes[_collapsed(codes)]
            self.tables.append(Automaton(codes.tolist(), self.width))
            self.bits.append(math.log2(max(2, len(codes))))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) phrases; symbols; letters of each text."""
        lens = np.array([len(x) for x in texts], np.int64)
        codes = self.code[_points("".join(texts))]
        owner = np.repeat(np.arange(len(texts)), lens)
        letters = np.bincount(owner[codes > 0], minlength=len(texts))
        keep = _collapsed(codes)
        keep |= np.concatenate([[True], owner[1:] != owner[:-1]])[: len(keep)]
        codes, owner = codes[keep], owner[keep]
        size = np.bincount(owner, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        blocks = -(-size // self.block)
        of = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = first[of] + nth * self.block
        length = np.minimum(size[of] - nth * self.block, self.block)
        order = np.argsort(-length, kind="stable")
        start, length, of = start[order], length[order], of[order]
        out = np.zeros((len(texts), len(self.langs)))
        if len(of):
            active = len(of) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")
            states = np.zeros((len(self.tables), len(of)), np.int32)
            counts = np.zeros((len(self.tables), len(of)), np.int32)
            for t in range(int(length[0])):
                k = active[t]
                c = codes[start[:k] + t]
                for i, table in enumerate(self.tables):
                    e = table.step(states[i, :k], c)
                    counts[i, :k] += e & 1
                    states[i, :k] = e >> 1
            for i in range(len(self.tables)):
                out[:, i] = np.bincount(of, weights=counts[i], minlength=len(texts))
        return out, size, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, bits a symbol of the best) of each text."""
        if not self.langs:
            return [(UND, 0.0, 0.0)] * len(texts)
        counts, size, letters = self.phrases(texts)
        bits = counts * np.array(self.bits) / np.maximum(size, 1)[:, None]
        best = np.argmin(bits, axis=1)
        low = bits[np.arange(len(texts)), best]
        rest = bits.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1) if len(self.langs) > 1 else np.full(len(texts), np.inf)
        score = np.clip(1 - low / np.where(second > 0, second, 1), 0, 1)
        return [(self.langs[b], float(s), float(x)) if n else (UND, 0.0, 0.0) for b, s, x, n in zip(best, score, low, letters, strict=True)]


_parsers: dict[tuple, Parser] = {}


def _parser(texts: dict[str, str], block: int) -> Parser:
    key = (tuple(sorted(texts.items())), block)
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(texts, block)
    return _parsers[key]


def _forget() -> None:
    _parsers.clear()


def identify(df: DataFrame, texts: dict[str, str], *, text_col: str = "text", block: int = 1024, prefix: str = "") -> DataFrame:
    """df with lang_pred, score and bits (a symbol) added, in place of columns so named; texts: labelled text for each
    language, from sample()."""
    df = df.drop(*(prefix + c for c in ADDED))
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    out = StructType([*df.schema.fields, StructField(prefix + "lang_pred", StringType()), StructField(prefix + "score", DoubleType()), StructField(prefix + "bits", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("language_id", _forget)
        parser = _parser(texts, block)
        for batch in sub_batches(batches, text_col, 1 << 20):
            found = parser.predict([x or "" for x in batch.column(text_col).to_pylist()])
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [f.name for f in out.fields])

    return map_arrow(df, run, out)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), sample(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits")
