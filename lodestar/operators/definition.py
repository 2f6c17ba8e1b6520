"""Go to definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import match
from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.plans import relations as R
from lodestar.plans.relations import take
from lodestar.schema import Role

CANDIDATES = 20
LINES = 64  # of a bucket by which places and occurrences of a file meet


def candidates(index: CodeIndex, wanted: str, limit: int = CANDIDATES, protocols_first: bool = False) -> DataFrame:
    """(symbol_id, kind, documentation, rank, id): symbols whose id holds the text, types of that name first."""
    s = index.symbols.where(match.contains(F.col("symbol_id"), wanted)).withColumn("rank", match.type_rank(F.col("symbol_id"), wanted))
    order: list[Column] = [F.col("rank")]
    if protocols_first:
        order.append(F.when(F.col("kind") == "protocol", 0).otherwise(1))
    return take(s.orderBy(*order, "id").select("symbol_id", "kind", "documentation", "rank", "id"), limit)


def definitions(index: CodeIndex, only: DataFrame | None = None) -> DataFrame:
    """A row for each symbol: symbol, kind, module, file, line, column, snippet, inherits, conformances, members,
    documentation. only: a small relation of symbol_ids, to answer for these alone."""
    pick = (lambda df, key: df) if only is None else (lambda df, key: df.join(F.broadcast(only.select(F.col("symbol_id").alias(key))), key, "left_semi"))
    narrow = CodeIndex(index.metadata, index.index_state, index.documents, pick(index.symbols, "symbol_id"), pick(index.relationships, "symbol_id"), index.occurrences)
    owners = CodeIndex(index.metadata, index.index_state, index.documents, index.symbols, index.relationships, pick(index.occurrences, "enclosing_symbol"))
    sites = CodeIndex(index.metadata, index.index_state, index.documents, index.symbols, index.relationships, pick(index.occurrences, "symbol_id"))
    out = R.first_symbols(narrow).join(R.definition_sites(sites), "symbol_id", "left").join(R.edges(narrow), "symbol_id", "left")
    out = out.join(R.members(owners).withColumnRenamed("owner", "symbol_id"), "symbol_id", "left")
    return out.select("symbol_id", S.name(F.col("symbol_id")).alias("symbol"), "kind", S.module(F.col("symbol_id")).alias("module"), "file", "line", "column", "snippet", "inherits", "conformances", "members", "documentation")


def by_id(index: CodeIndex, symbol_id: str) -> DataFrame:
    """definitions() for one id; no row if there is no such symbol."""
    return definitions(index, index.symbols.where(F.col("symbol_id") == symbol_id).select("symbol_id").distinct())


def by_name(index: CodeIndex, wanted: str) -> DataFrame:
    """definitions() for the best candidate. Candidates are symbols, so the first one always has a row."""
    return definitions(index, candidates(index, wanted, 1))


def covering(index: CodeIndex) -> DataFrame:
    """(relative_path, start_line, end_line, symbol_id, ...): occurrences with their paths."""
    docs = index.documents.select(F.col("id").alias("file_id"), "relative_path")
    return index.occurrences.join(docs, "file_id")


def at_position(index: CodeIndex, path: str | Column, line: int) -> DataFrame:
    """(symbol_id): of the occurrences whose lines cover a place, references first, then the one that starts last."""
    rows = covering(index).where((F.col("relative_path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line))
    reference = F.when(S.has_role(F.col("roles"), Role.REFERENCE), 0).otherwise(1)
    return rows.orderBy(reference, F.col("start_line").desc(), "id").limit(1).select("symbol_id")


def at_positions(index: CodeIndex, places: DataFrame) -> DataFrame:
    """(relative_path, line, symbol_id) for many places (relative_path, line): an equi-join on the file and a bucket of its
    lines with the range as its residual, then the best row of each place by a partial aggregate. So the work grows with
    the occurrences near a place, not with those of its file."""
    reference = F.when(S.has_role(F.col("roles"), Role.REFERENCE), 0).otherwise(1)
    bucket = lambda c: F.floor(F.col(c) / LINES)
    spans = F.explode(F.sequence(bucket("start_line"), F.greatest(bucket("start_line"), bucket("end_line"))))
    rows = covering(index).select("*", reference.alias("reference"), spans.alias("bucket"))
    asked = places.select("relative_path", "line").distinct().withColumn("bucket", bucket("line"))
    hit = asked.join(rows, ["relative_path", "bucket"]).where("start_line <= line and end_line >= line")
    return hit.groupBy("relative_path", "line").agg(F.min_by("symbol_id", F.struct("reference", (-F.col("start_line")).alias("s"), "id")).alias("symbol_id"))


def wanted_symbol(index: CodeIndex, wanted: str, path: str | Column | None = None, line: int | None = None) -> DataFrame:
    """(symbol_id): at most one row. The symbol at a place, if both path and line are given (a line 0 is none) and something
    is there, be it known or not; else the best candidate by name."""
    named = candidates(index, wanted, 1).select("symbol_id")
    if path is None or not line:
        return named
    at = at_position(index, path, line)
    nothing = at.agg((F.count(F.lit(1)) == 0).alias("nothing")).scalar()
    return at.unionByName(named.where(nothing))


def go_to(index: CodeIndex, wanted: str, path: str | Column | None = None, line: int | None = None) -> DataFrame:
    """definitions() of wanted_symbol(): no row if that is no known symbol."""
    return definitions(index, wanted_symbol(index, wanted, path, line))
