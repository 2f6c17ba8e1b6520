"""Column helpers of the operators that run on DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import LAST_ID

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 8 << 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, th, doc_id, text) of every row: d and th tell documents apart even if ids are null or repeated."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("d"), F.xxhash64(text).alias("th"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df has."""
    out = F.lit(0).cast("long")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            out = out + F.octet_length(F.to_json(F.struct(f.name)))
        else:
            out = out + 8
    return out


def small(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if it has at most `most` rows and `most_bytes` bytes (both are counted; df should be a table that
    is read back)."""
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= most and size <= most_bytes else df
