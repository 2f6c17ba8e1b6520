"""The navigation operators as calls that return plain records."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar import render
from lodestar.config import Settings
from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.operators import definition, implementations, references, search, status


class Navigator:
    """Answers questions to one index. Rows that reach the driver are a page or a single record."""

    def __init__(self, index: CodeIndex):
        self.index = index

    @classmethod
    def open(cls, spark: SparkSession, settings: Settings) -> Navigator:
        """Over the configured database file, or a folder of Parquet tables."""
        path = settings.db_path
        if path.is_dir():
            return cls(CodeIndex.from_parquet(spark, str(path)))
        return cls(CodeIndex.from_sqlite(spark, str(path)))

    def _parsed(self, frame) -> tuple[str, str, str | None] | None:
        """(id, name, module) of the only row, if any."""
        row = frame.select("symbol_id", S.name(F.col("symbol_id")).alias("name"), S.module(F.col("symbol_id")).alias("module")).first()
        return tuple(row) if row else None

    def go_to_definition(self, symbol: str, file_path: str | None = None, line: int | None = None) -> dict[str, Any] | None:
        """The record of the symbol at a place if both file and line are given and something is there (None if that is no
        known symbol), else of the best match by name; None if there is none."""
        row = definition.go_to(self.index, symbol, file_path or None, line).first()
        return render.definition(row) if row else None

    def find_references(self, symbol: str, include_definitions: bool = False, limit: int = 50) -> dict[str, Any]:
        best = self._parsed(references.best(self.index, symbol))
        if best is None:
            return render.references(symbol, 0, [], None)
        total = references.count(self.index, best[0], include_definitions).first()["reference_count"]
        rows = references.page(self.index, best[0], include_definitions, limit).collect()
        return render.references(best[1], total, rows, best[2])

    def find_implementations(self, protocol: str, limit: int = 50) -> dict[str, Any]:
        best = self._parsed(implementations.protocol(self.index, protocol))
        rows = implementations.of_target(self.index, best[0], limit).collect() if best else []
        return {"protocol": best[1] if best else protocol, "implementation_count": len(rows), "implementations": [render.implementation(r) for r in rows]}

    def search_symbols(self, query: str, kind: str | None = None, module: str | None = None, limit: int = 25) -> list[dict[str, Any]]:
        return [render.match(r) for r in search.search(self.index, query, kind, module, limit).collect()]

    def get_metadata(self, key: str) -> str | None:
        row = status.metadata(self.index, key).first()
        return row["value"] if row else None

    def get_index_state(self) -> dict[str, Any] | None:
        row = status.state(self.index).first()
        return row.asDict() if row else None

    def status(self) -> dict[str, Any]:
        state = self.get_index_state()
        out = status.summary(self.index).first().asDict()
        out |= {"last_commit": state["last_commit_hash"] if state else "N/A", "last_indexed": state["last_indexed_at"] if state else "N/A"}
        return out | {r["relation"]: r["n"] for r in status.counts(self.index).collect()}
