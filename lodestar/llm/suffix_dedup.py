"""Suffix-array dedup: bytes that lie in a string of `length` bytes which also starts in a document with a smaller id.

Texts are UTF-8 bytes; matches never cross documents; overlaps count; strings are judged on the input. Strings that may
repeat are dealt to shards by their anchor (see repeats.py), and only their distinct surroundings are kept there. Each
shard concatenates those, sorts the suffixes by the difference-cover algorithm (suffix_array.py), compares adjacent
prefixes of `length` bytes and takes the least document of each run of equal ones. Equal strings always meet in one
shard, so the shards' suffix arrays together find what one array of all texts would.

Defined cases: null text is empty; a null id counts as greater than all others and rows without id don't precede each
other; rows that repeat an id don't precede each other, either; kept bytes need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import repeats
from lodestar.llm.common import table
from lodestar.llm.suffix_array import equal_windows

BATCH = 1 << 20


def by_suffixes(length: int) -> repeats.Method:
    def method(body: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> np.ndarray:
        begin = np.cumsum(sizes) - sizes
        text = np.zeros(len(body) + len(sizes), np.int64)  # a 0 after each content
        text[np.arange(len(body)) + np.repeat(np.arange(len(sizes)), sizes)] = body.astype(np.int64) + 1
        return equal_windows(text, repeats._spans(begin + np.arange(len(sizes)), windows), length)

    return method


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>>) of every row; spans are removed."""

    def finish(batch: pa.RecordBatch, units: repeats.Bytes, gone: np.ndarray) -> list[dict]:
        data, offsets, out = units.data, units.offsets, []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            edge = np.diff(gone[a:b].astype(np.int8), prepend=0, append=0)
            spans = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)
            kept = data[a:b][~gone[a:b]] if len(spans) else data[a:b]
            out.append({"n_bytes": b - a, "n_removed": b - a - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept.tobytes()).hexdigest(), "spans": [{"start": x, "end": y} for x, y in spans.tolist()]})
        return out

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))])
    columns = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return repeats.marked(df, repeats.Bytes, (max(1, length // 3), length), by_suffixes(length), finish, columns, schema, id_col=id_col, text_col=text_col, most=BATCH)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("spans")


ORACLE_SQL = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
win as (select doc_id, i, substr(h, 2 * i - 1, 100) s from (select doc_id, h, unnest(range(1, length(h) // 2 - 48)) i from b)),
m as (select s, min(doc_id) f from win group by s),
g as (select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) p from win join m using (s) where f < doc_id)),
n as (select doc_id, count(*) n_removed, count(*) filter (where before is null or before < p - 1) n_spans from (select doc_id, p, lag(p) over (partition by doc_id order by p) before from g) group by doc_id),
k as (select doc_id, string_agg(substr(h, 2 * p - 1, 2), '' order by p) kept from (select doc_id, h, unnest(range(1, length(h) // 2 + 1)) p from b) anti join g using (doc_id, p) group by doc_id)
select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
from b left join n using (doc_id) left join k using (doc_id)
"""
