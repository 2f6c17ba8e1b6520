"""Find references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.operators.definition import candidates
from lodestar.plans.relations import take
from lodestar.schema import Role


def _wanted(include_definitions: bool) -> Column:
    return F.lit(True) if include_definitions else ~S.has_role(F.col("roles"), Role.DEFINITION)


def pages(index: CodeIndex, include_definitions: bool = False) -> DataFrame:
    """(symbol_id, file, line, column, snippet, context, id) of all references in known documents."""
    docs = index.documents.select(F.col("id").alias("file_id"), F.col("relative_path").alias("file"))
    rows = index.occurrences.where(_wanted(include_definitions)).join(docs, "file_id")
    context = S.name(F.nullif(F.col("enclosing_symbol"), F.lit("")))
    return rows.select("symbol_id", "file", F.col("start_line").alias("line"), F.col("start_column").alias("column"), F.nullif(F.col("snippet"), F.lit("")).alias("snippet"), context.alias("context"), "id")


def page(index: CodeIndex, symbol_id: str, include_definitions: bool = False, limit: int = 50) -> DataFrame:
    """References of one symbol by file and line."""
    return take(pages(index, include_definitions).where(F.col("symbol_id") == symbol_id).orderBy("file", "line", "id"), limit)


def counts(index: CodeIndex, include_definitions: bool = False) -> DataFrame:
    """(symbol_id, reference_count): all references, those in unknown documents as well."""
    return index.occurrences.where(_wanted(include_definitions)).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("reference_count"))


def count(index: CodeIndex, symbol_id: str, include_definitions: bool = False) -> DataFrame:
    rows = index.occurrences.where((F.col("symbol_id") == symbol_id) & _wanted(include_definitions))
    return rows.agg(F.count(F.lit(1)).alias("reference_count"))


def by_module(index: CodeIndex, include_definitions: bool = False) -> DataFrame:
    """(module, reference_count): listed references by the module of the symbol they refer to."""
    module = F.coalesce(S.module(F.col("symbol_id")), F.lit("Unknown"))
    known = pages(index, include_definitions).groupBy("symbol_id").agg(F.count(F.lit(1)).alias("n"))
    return known.groupBy(module.alias("module")).agg(F.sum("n").alias("reference_count"))


def best(index: CodeIndex, wanted: str) -> DataFrame:
    """(symbol_id) of the best candidate."""
    return candidates(index, wanted, 1).select("symbol_id")
