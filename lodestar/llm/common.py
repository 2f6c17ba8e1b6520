"""Shared plumbing of the corpus operators: tables, lineage cuts, Arrow text batches, components."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.storage import delete, session_dir

EDGES = 1 << 21  # of a partition whose components are found at once
LAST_ID = 2**63 - 1  # stands for a null doc_id: such a document precedes no other


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_watched: list[list[str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _watched:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def watched() -> Iterator[list[str]]:
    """Gathers where cut() writes tables inside the block."""
    paths: list[str] = []
    _watched.append(paths)
    try:
        yield paths
    finally:
        _watched.pop()


def forget(*tables: DataFrame) -> None:
    """Delete tables that cut() has written and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/lodestar-" in f}:
            delete(spark, folder)


def clean(spark: SparkSession) -> None:
    """Delete all tables that operators have written in this session. Results that are read lazily from them are lost, too:
    call it when results have been written."""
    delete(spark, session_dir(spark))


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of df has, however upper and lower case count."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def tasks(df: DataFrame) -> int:
    """How many partitions a shuffle of this session makes."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sub_batches(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each has about `most` bytes of text, or one row."""
    for batch in batches:
        col = batch.column(text)
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), dtype=np.float64))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. offsets has one entry more than the column."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = pc.fill_null(col, b"")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_CODEC = pa.Codec("zstd", compression_level=3)


def squeeze(values: np.ndarray) -> bytes:
    """The bytes of an array, compressed; the first 8 tell how many they were."""
    raw = np.ascontiguousarray(values).tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unsqueezed(parts: list[bytes | None], dtype) -> np.ndarray:
    """The arrays of squeeze(), one after the other."""
    return np.frombuffer(b"".join(_CODEC.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True) for x in parts if x), dtype=dtype)


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The bytes of a binary column without nulls, one value after the other, as an array."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in column.chunks:
        if len(chunk) and chunk.buffers()[2] is not None:
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]])
    return np.concatenate(parts).view(dtype)


_holder: tuple[str, Callable[[], None]] | None = None


def hold(name: str, drop: Callable[[], None]) -> None:
    """Called where an operator's tasks begin: the caches that another operator's tasks have left in this worker go.

    A worker serves one operator after another, so it should hold what one of them keeps, not all. drop empties the
    caller's own caches."""
    global _holder
    if _holder and _holder[0] != name:
        _holder[1]()
        release()
    _holder = (name, drop)


def release() -> None:
    """Give memory that is free in this worker back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        release()

    return df.mapInArrow(run, schema)


def stars(edges: np.ndarray) -> np.ndarray:
    """Edges (node, least node of its group) that connect what these edges connect."""
    if not len(edges):
        return edges.reshape(0, 2)
    ids, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, at[:, 0], root[at[:, 1]])
        np.minimum.at(low, at[:, 1], root[at[:, 0]])
        low = low[low]
        if (low == root).all():
            break
        root = low
    other = np.flatnonzero(root != np.arange(len(ids)))
    return np.stack([ids[other], ids[root[other]]], axis=1)


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: what the edges (u, v) of each partition connect, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, new, n = np.zeros((0, 2), np.int64), [], 0
        for batch in batches:
            new.append(np.stack([batch.column(x).to_numpy() for x in ("u", "v")], axis=1))
            n += batch.num_rows
            if n > max(1 << 20, len(have)):
                have, new, n = stars(np.concatenate([have, *new])), [], 0
        have = stars(np.concatenate([have, *new]))
        yield pa.RecordBatch.from_arrays([pa.array(have[:, 0]), pa.array(have[:, 1])], names=["u", "v"])

    return map_arrow(edges, run, "u long, v long")


def _are_stars(e: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(False).alias("top")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(True).alias("top")))
    return ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where("n > 1 or (n = 1 and top)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component), component the least node id reachable; nodes without an edge are absent.

    The edges of each partition become stars, those of as many partitions together as have EDGES of them again. If that
    leaves several partitions, large and small stars alternate until the whole edge list is stars. Each round is a
    partially aggregated min per node, written, and a join of the edges with it: broadcast if it has few rows, else a
    shuffled join of two tables, whose hot nodes the adaptive skew join splits.
    """
    from lodestar.llm.native import small

    def contract(e: DataFrame) -> tuple[DataFrame, int]:
        first = cut(_contracted(e))
        parts = -(-first.count() // EDGES)
        out = cut(_contracted(first.coalesce(max(1, parts))))
        forget(first)
        return out, parts

    e, parts = contract(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v"))
    while parts > 1 and not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(small(first), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        second = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        near = large.join(small(second), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(second.select("u", F.col("m").alias("v")))
        old = e
        e, parts = contract(near.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        forget(old, first, large, second)
    e = e.distinct() if parts > 1 else e
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
