"""What an index says about itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.index import CodeIndex

COUNTED = ("documents", "symbols", "occurrences", "relationships")
KEYS = ("version", "tool", "project_root")


def counts(index: CodeIndex) -> DataFrame:
    """(relation, n) of the four large relations."""
    return reduce(DataFrame.unionByName, (getattr(index, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("relation"), "n") for t in COUNTED))


def metadata(index: CodeIndex, key: str) -> DataFrame:
    """(value): at most one row."""
    return index.metadata.where(F.col("key") == key).select("value").limit(1)


def summary(index: CodeIndex) -> DataFrame:
    """One row: version, tool, project_root, `unknown` where missing or empty."""
    at = lambda k: F.coalesce(F.nullif(F.max(F.when(F.col("key") == k, F.col("value"))), F.lit("")), F.lit("unknown")).alias(k)
    return index.metadata.agg(*map(at, KEYS))


def state(index: CodeIndex) -> DataFrame:
    """(last_commit_hash, last_indexed_at, indexed_files): the first row, if any; the relation has one by convention."""
    return index.index_state.limit(1)
