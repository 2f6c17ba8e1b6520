"""The index: six relations, their schemas, and the role bits of an occurrence."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import IntegerType, LongType, StringType, StructType


class SchemaError(ValueError):
    """An index lacks tables."""


class Role:
    """Bits of occurrences.roles. A reference is a read access."""

    DEFINITION = 1
    IMPORT = 2
    WRITE_ACCESS = 4
    READ_ACCESS = 8
    REFERENCE = 8
    GENERATED = 16
    TEST = 32


SCHEMAS = {
    "metadata": StructType().add("key", StringType(), False).add("value", StringType(), False),
    "index_state": StructType().add("last_commit_hash", StringType(), False).add("last_indexed_at", LongType(), False).add("indexed_files", StringType()),
    "documents": StructType()
    .add("id", LongType(), False)
    .add("relative_path", StringType(), False)
    .add("language", StringType(), False)
    .add("indexed_at", LongType(), False),
    "symbols": StructType()
    .add("id", LongType(), False)
    .add("symbol_id", StringType(), False)
    .add("kind", StringType())
    .add("documentation", StringType())
    .add("file_id", LongType()),
    "relationships": StructType()
    .add("id", LongType(), False)
    .add("symbol_id", StringType(), False)
    .add("target_symbol_id", StringType(), False)
    .add("kind", StringType(), False),
    "occurrences": StructType()
    .add("id", LongType(), False)
    .add("symbol_id", StringType(), False)
    .add("file_id", LongType(), False)
    .add("start_line", IntegerType(), False)
    .add("start_column", IntegerType(), False)
    .add("end_line", IntegerType(), False)
    .add("end_column", IntegerType(), False)
    .add("roles", IntegerType(), False)
    .add("enclosing_symbol", StringType())
    .add("snippet", StringType()),
}
TABLES = frozenset(SCHEMAS)


def check_tables(present: Iterable[str]) -> None:
    """Raise SchemaError if one of the six tables isn't among those present; columns are not looked at."""
    if missing := sorted(TABLES - set(present)):
        raise SchemaError(f"missing tables: {', '.join(missing)}")
