"""Index tables of a SQLite file, by the standard library's driver in read-only mode."""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestar.schema import SCHEMAS, check_tables

SPAN = 1 << 18  # rows of a task


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection; writes raise an error, a missing file FileNotFoundError."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    conn = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)
    conn.execute("pragma query_only = on")
    return conn


def tables(path: str) -> list[str]:
    conn = connect(path)
    try:
        return [r[0] for r in conn.execute("select name from sqlite_master where type = 'table'")]
    finally:
        conn.close()


class Rowids(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    """Reads one table by ranges of rowid with SPAN rows each, a task for each."""

    def __init__(self, path: str, name: str, columns: list[str]):
        self.path, self.name, self.columns = path, name, columns

    def partitions(self) -> list[Rowids]:
        conn = connect(self.path)
        try:
            first = [r[0] for r in conn.execute(f'select rowid from (select rowid, row_number() over (order by rowid) as n from "{self.name}") where n % ? = 1 or ? = 1', (SPAN, SPAN))]
            high = conn.execute(f'select max(rowid) from "{self.name}"').fetchone()[0]
        finally:
            conn.close()
        if not first:
            return [Rowids(0, -1)]
        return [Rowids(a, b) for a, b in zip(first, [*(x - 1 for x in first[1:]), high], strict=True)]

    def read(self, partition: Rowids):
        conn = connect(self.path)
        try:
            names = ", ".join(f'"{c}"' for c in self.columns)
            yield from conn.execute(f'select {names} from "{self.name}" where rowid between ? and ?', (partition.low, partition.high))
        finally:
            conn.close()


class IndexTable(DataSource):
    """format("sqlite_index"), options path and table (one of the six)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_index"

    def schema(self) -> StructType:
        return SCHEMAS[self.options["table"]]

    def reader(self, schema: StructType) -> DataSourceReader:
        return TableReader(self.options["path"], self.options["table"], schema.names)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The six tables; SchemaError if the file lacks one."""
    check_tables(tables(path))
    spark.dataSource.register(IndexTable)
    return {t: spark.read.format("sqlite_index").option("path", os.path.abspath(path)).option("table", t).load() for t in SCHEMAS}
