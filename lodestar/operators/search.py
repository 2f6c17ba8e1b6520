"""Search symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import match
from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.plans import relations as R
from lodestar.plans.relations import take


def rows(index: CodeIndex, query: str, kind: str | None = None, module: str | None = None, limit: int = 25) -> DataFrame:
    """(symbol_id, kind, file, line, snippet, rank, sid, oid): matches joined with all their definitions, limited as they
    stand: a symbol with two definitions takes two places."""
    s = index.symbols.where(match.found(F.col("symbol_id"), query))
    if kind:
        s = s.where(F.col("kind") == kind)
    if module:
        s = s.where(match.in_module(F.col("symbol_id"), module))
    d = R.definitions(index).select("symbol_id", "file_id", F.col("id").alias("oid"), "start_line", "snippet")
    docs = index.documents.select(F.col("id").alias("file_id"), F.nullif(F.col("relative_path"), F.lit("")).alias("file"))
    s = s.select("symbol_id", "kind", F.col("id").alias("sid"), match.type_rank(F.col("symbol_id"), query).alias("rank"))
    if limit >= 0:
        # A match has at least one row, so those beyond the limit in this order can't be on the page.
        s = s.orderBy("rank", "symbol_id", "sid").limit(limit)
    found = s.join(d, "symbol_id", "left").join(docs, "file_id", "left")
    found = found.select("symbol_id", "kind", "file", F.when(F.col("file").isNotNull(), F.col("start_line")).alias("line"), F.nullif(F.col("snippet"), F.lit("")).alias("snippet"), "rank", "sid", "oid")
    return take(found.orderBy("rank", "symbol_id", "sid", F.col("oid").asc_nulls_first()), limit)


def search(index: CodeIndex, query: str, kind: str | None = None, module: str | None = None, limit: int = 25) -> DataFrame:
    """(symbol_id, name, kind, module, file, line, snippet), one row for a symbol, in order: the first of each among rows()."""
    page = rows(index, query, kind, module, limit)
    first = F.min_by(F.struct("kind", "file", "line", "snippet"), F.struct("sid", F.coalesce("oid", F.lit(-1))))
    kept = page.groupBy("symbol_id").agg(F.min("rank").alias("rank"), first.alias("r")).orderBy("rank", "symbol_id")
    return kept.select("symbol_id", S.name(F.col("symbol_id")).alias("name"), "r.kind", S.module(F.col("symbol_id")).alias("module"), "r.file", "r.line", "r.snippet")
