"""Relations for all symbols at once. Every operator on one symbol is a filter on one of these; Catalyst pushes it to the
scan. "First" rows are found by min_by, which aggregates before the shuffle, rather than by sorting each key's rows.
Where the order that decides isn't total, the lower id goes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.schema import Role

SUPERTYPES = ("conforms", "implements", "inherits")


def first_symbols(index: CodeIndex) -> DataFrame:
    """(symbol_id, kind, documentation): of ids that occur twice, the row with the lower id."""
    s = index.symbols
    return s.groupBy("symbol_id").agg(F.min_by(F.struct("kind", "documentation"), "id").alias("s")).select("symbol_id", "s.kind", "s.documentation")


def definitions(index: CodeIndex) -> DataFrame:
    return index.occurrences.where(S.has_role(F.col("roles"), Role.DEFINITION))


def definition_sites(index: CodeIndex) -> DataFrame:
    """(symbol_id, file, line, column, snippet): the first definition by line, of those in a known document."""
    docs = index.documents.select(F.col("id").alias("file_id"), "relative_path")
    site = F.struct(F.col("relative_path").alias("file"), F.col("start_line").alias("line"), F.col("start_column").alias("column"), "snippet")
    known = definitions(index).join(docs, "file_id")
    return known.groupBy("symbol_id").agg(F.min_by(site, F.struct("start_line", "id")).alias("site")).select("symbol_id", "site.*")


def member_rows(index: CodeIndex) -> DataFrame:
    """(owner, symbol_id, kind), distinct: symbols defined inside another."""
    inner = definitions(index).where(F.col("enclosing_symbol").isNotNull()).select(F.col("enclosing_symbol").alias("owner"), "symbol_id").distinct()
    return inner.join(index.symbols.select("symbol_id", "kind").distinct(), "symbol_id").select("owner", "symbol_id", "kind")


def members(index: CodeIndex) -> DataFrame:
    """(owner, members): what is shown of the members, by symbol id."""
    row = F.struct("symbol_id", S.member(S.name(F.col("symbol_id")), F.col("kind")).alias("label"))
    return member_rows(index).groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(row)), lambda m: m["label"]).alias("members"))


def edges(index: CodeIndex) -> DataFrame:
    """(symbol_id, inherits, conformances): names of the supertypes in row order; other kinds of edge are left out."""
    label = S.name(F.col("target_symbol_id"))
    rows = index.relationships.where(F.col("kind").isin(*SUPERTYPES))
    pick = lambda up: F.transform(F.filter(F.array_sort("rows"), lambda r: (r["kind"] == "inherits") == F.lit(up)), lambda r: r["label"])
    grouped = rows.groupBy("symbol_id").agg(F.collect_list(F.struct("id", label.alias("label"), "kind")).alias("rows"))
    return grouped.select("symbol_id", pick(True).alias("inherits"), pick(False).alias("conformances"))


def implementers(index: CodeIndex) -> DataFrame:
    """(target, symbol_id, kind, relationship_kind), distinct, one hop."""
    r = index.relationships.where(F.col("kind").isin(*SUPERTYPES)).select(F.col("target_symbol_id").alias("target"), "symbol_id", F.col("kind").alias("relationship_kind"))
    return r.join(index.symbols.select("symbol_id", "kind"), "symbol_id").select("target", "symbol_id", "kind", "relationship_kind").distinct()


def take(df: DataFrame, limit: int) -> DataFrame:
    """limit(), where a negative limit is none."""
    return df if limit < 0 else df.limit(limit)
