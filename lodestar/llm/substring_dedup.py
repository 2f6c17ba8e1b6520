"""Substring dedup by level-wise doubling: words that lie in a window of `length` words which also starts in a document
with a smaller id.

`levels(length)` halves the length down to `SHORT` words or less. Windows of the shortest length are looked up in all
documents; only where one is repeated are windows of the next length made and looked up, and so on, until the full length
is reached or no candidate survives (see repeats.py: of each window of the next length, the window with the least hash in
it is what is looked up). At the full length what still stands is compared by its words: they are numbered by their
bytes, and numbers of 1, 2, 4 … words in a row are named anew by pairs of names, again only where both names repeat.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, compared as they are. Windows are judged on the input.

Defined cases: null text has no words; a null id counts as greater than all others and rows without id don't precede each
other; rows that repeat an id don't precede each other, either; an empty table gives an empty result; texts may be of
any length, memory grows with the longest; other columns of the table are neither read nor returned.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import hashes as H
from lodestar.llm import repeats
from lodestar.llm.common import table

BATCH = 1 << 22
SHORT = 16


def levels(length: int) -> tuple[int, ...]:
    """Window lengths from the first level to the last, each at most twice the one before; two at least."""
    out = [length, max(1, -(-length // 2))]
    while out[-1] > SHORT:
        out.append(-(-out[-1] // 2))
    return tuple(out[::-1])


def by_doubling(length: int) -> repeats.Method:
    def method(body: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        gaps = np.flatnonzero(body == 32)
        start = np.sort(np.concatenate([ends - sizes, gaps + 1]))
        end = np.sort(np.concatenate([ends, gaps]))
        name, n = H.exact(body, start, end, H.spans(body, start, end))
        first = np.cumsum(windows + length - 1) - (windows + length - 1)
        at = repeats._spans(first, windows)
        have = 1
        while have < length:
            step = min(have, length - have)
            left, right = name[:-step], name[step:]
            both = np.flatnonzero((left >= 0) & (right >= 0))
            key, of, times = np.unique(left[both] * n + right[both], return_inverse=True, return_counts=True)
            name, n = np.full(len(left), -1, np.int64), max(1, len(key))
            # A window that occurs once has no name: nothing longer that holds it can repeat.
            name[both] = np.where(times[of] > 1, of, -1)
            have += step
        out = name[at]
        alone = out < 0
        out[alone] = n + np.arange(int(alone.sum()))
        return out

    return method


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept (the words that stay, joined by a space)) of every row."""

    def finish(batch: pa.RecordBatch, units: repeats.Words, gone: np.ndarray) -> list[dict]:
        raw, at, out = units.data.tobytes(), units.offsets.tolist(), []
        for a, b in pairwise(at):
            stay = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([raw[x:y] for x, y in zip(units.start[stay].tolist(), units.end[stay].tolist(), strict=True)])
            out.append({"n_words": b - a, "n_removed": b - a - len(stay), "kept": kept.decode()})
        return out

    schema = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
    columns = "n_words long, n_removed long, kept string"
    return repeats.marked(df, repeats.Words, levels(length), by_doubling(length), finish, columns, schema, id_col=id_col, text_col=text_col, most=BATCH)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
win as (select doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') s from (select doc_id, ws, unnest(range(1, len(ws) - 48)) i from w)),
m as (select s, min(doc_id) f from win group by s),
g as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) p from win join m using (s) where f < doc_id)),
k as (select doc_id, string_agg(x, ' ' order by p) kept, count(*) n from (select doc_id, unnest(ws) x, generate_subscripts(ws, 1) p from w) anti join g using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint n_words, (len(ws) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k using (doc_id)
"""
