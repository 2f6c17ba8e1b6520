"""Find implementations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.operators.definition import candidates
from lodestar.plans import relations as R
from lodestar.plans.relations import take


def implementations(index: CodeIndex) -> DataFrame:
    """(target, symbol_id, relationship_kind, name, kind, module, file, line, snippet, members_implemented) for all targets.

    A symbol with two kinds of edge to a target is there twice."""
    sites = R.definition_sites(index).select("symbol_id", "file", "line", F.nullif(F.col("snippet"), F.lit("")).alias("snippet"))
    rows = R.implementers(index).join(sites, "symbol_id", "left").join(R.members(index).withColumnRenamed("owner", "symbol_id"), "symbol_id", "left")
    return rows.select("target", "symbol_id", "relationship_kind", S.name(F.col("symbol_id")).alias("name"), "kind", S.module(F.col("symbol_id")).alias("module"), "file", "line", "snippet", F.col("members").alias("members_implemented"))


def protocol(index: CodeIndex, wanted: str) -> DataFrame:
    """(symbol_id) of the best candidate, protocols first."""
    return candidates(index, wanted, 1, protocols_first=True).select("symbol_id")


def of_target(index: CodeIndex, target: str, limit: int = 50) -> DataFrame:
    """implementations() of one target, by symbol id. The limit applies before locations and members are looked up."""
    few = take(R.implementers(index).where(F.col("target") == target).orderBy("symbol_id", "kind", "relationship_kind"), limit)
    ids = F.broadcast(few.select("symbol_id").distinct()) if 0 <= limit <= 10_000 else few.select("symbol_id").distinct()
    inner = CodeIndex(index.metadata, index.index_state, index.documents, index.symbols, index.relationships, index.occurrences.join(ids, "symbol_id", "left_semi"))
    owned = CodeIndex(index.metadata, index.index_state, index.documents, index.symbols, index.relationships, index.occurrences.join(ids.withColumnRenamed("symbol_id", "enclosing_symbol"), "enclosing_symbol", "left_semi"))
    sites = R.definition_sites(inner).select("symbol_id", "file", "line", F.nullif(F.col("snippet"), F.lit("")).alias("snippet"))
    rows = few.join(sites, "symbol_id", "left").join(R.members(owned).withColumnRenamed("owner", "symbol_id"), "symbol_id", "left")
    return rows.orderBy("symbol_id", "kind", "relationship_kind").select("symbol_id", "relationship_kind", S.name(F.col("symbol_id")).alias("name"), "kind", S.module(F.col("symbol_id")).alias("module"), "file", "line", "snippet", F.col("members").alias("members_implemented"))
