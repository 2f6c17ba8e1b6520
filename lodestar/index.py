"""A code index as six DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from lodestar import storage
from lodestar.schema import SCHEMAS, check_tables


@dataclass(frozen=True)
class CodeIndex:
    metadata: DataFrame
    index_state: DataFrame
    documents: DataFrame
    symbols: DataFrame
    relationships: DataFrame
    occurrences: DataFrame

    @classmethod
    def from_frames(cls, frames: Mapping[str, DataFrame]) -> CodeIndex:
        check_tables(frames)
        return cls(**{f.name: frames[f.name] for f in fields(cls)})

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Mapping[str, Iterable[tuple]]) -> CodeIndex:
        """From tuples in the order of SCHEMAS; a table that isn't given is empty."""
        return cls.from_frames({t: spark.createDataFrame(list(rows.get(t, ())), s) for t, s in SCHEMAS.items()})

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> CodeIndex:
        """From `folder/<table>.parquet`; a table that isn't there raises SchemaError."""
        check_tables(storage.catalogue(spark, folder))
        return cls.from_frames({t: spark.read.schema(s).parquet(f"{folder}/{t}.parquet") for t, s in SCHEMAS.items()})

    @classmethod
    def from_sqlite(cls, spark: SparkSession, path: str) -> CodeIndex:
        """From an indexer's database file, read-only. The path must be readable where tasks run."""
        from lodestar.sources import sqlite

        return cls.from_frames(sqlite.read_index(spark, path))

    def cached(self) -> CodeIndex:
        """The same index, kept in memory once read: for many questions to one index."""
        return CodeIndex(**{f.name: getattr(self, f.name).cache() for f in fields(self)})

    def write(self, folder: str, parts: int | None = None) -> None:
        """As Parquet, occurrences and symbols dealt and sorted by symbol so that a lookup skips most row groups."""
        for f in fields(self):
            df = getattr(self, f.name)
            if f.name in ("symbols", "occurrences", "relationships"):
                df = (df.repartition(parts, "symbol_id") if parts else df.repartition("symbol_id")).sortWithinPartitions("symbol_id", "id")
            df.write.mode("overwrite").parquet(f"{folder}/{f.name}.parquet")
