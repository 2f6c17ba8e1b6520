"""Answers as a caller sees them: dictionaries without empty parts, JSON, terminal lines."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Row

SHOWN = 10  # members on a terminal line


def sparse(record: dict[str, Any]) -> dict[str, Any]:
    return {k: v for k, v in record.items() if v}


def definition(row: Row) -> dict[str, Any]:
    out: dict[str, Any] = {"symbol": row["symbol"], "kind": row["kind"], "module": row["module"]}
    if row["line"] is not None:
        out["definition"] = {k: row[k] for k in ("file", "line", "column", "snippet")}
    return out | sparse({k: row[k] for k in ("inherits", "conformances", "members", "documentation")})


def reference(row: Row) -> dict[str, Any]:
    return {k: row[k] for k in ("file", "line", "column")} | sparse({k: row[k] for k in ("snippet", "context")})


def references(symbol: str, total: int, rows: Iterable[Row], module: str | None) -> dict[str, Any]:
    page = [reference(r) for r in rows]
    out: dict[str, Any] = {"symbol": symbol, "reference_count": total, "references": page}
    if page:
        out["grouped_by_module"] = {module or "Unknown": len(page)}
    return out


def implementation(row: Row) -> dict[str, Any]:
    out: dict[str, Any] = {k: row[k] for k in ("name", "kind", "module")}
    if row["line"] is not None:
        out |= {"file": row["file"], "line": row["line"]}
    return out | sparse({k: row[k] for k in ("snippet", "members_implemented")})


def match(row: Row) -> dict[str, Any]:
    out: dict[str, Any] = {k: row[k] for k in ("name", "kind", "module")}
    if row["file"]:
        out |= {"file": row["file"], "line": row["line"]}
    return out | sparse({"snippet": row["snippet"]})


def to_json(payload: Any) -> str:
    return json.dumps(payload, indent=2, ensure_ascii=False)


def definition_lines(record: dict[str, Any]) -> list[str]:
    out = [f"{record['symbol']} ({record.get('kind')})"]
    if record.get("module"):
        out.append(f"  Module: {record['module']}")
    if site := record.get("definition"):
        out.append(f"  File: {site['file']}:{site['line']}")
        if site.get("snippet"):
            out.append(f"  {site['snippet']}")
    for key, title in (("inherits", "Inherits"), ("conformances", "Conforms to"), ("members", "Members")):
        if names := record.get(key):
            out.append(f"  {title}: {', '.join(names[:SHOWN] if key == 'members' else names)}")
            if key == "members" and len(names) > SHOWN:
                out.append(f"    ... and {len(names) - SHOWN} more")
    return out


def reference_lines(record: dict[str, Any]) -> list[str]:
    out = [f"{record['symbol']} - {record['reference_count']} references"]
    for r in record["references"]:
        out.append(f"  {r['file']}:{r['line']}" + (f" (in {r['context']})" if r.get("context") else ""))
        if r.get("snippet"):
            out.append(f"    {r['snippet']}")
    return out


def grid(titles: list[str], rows: list[list[str]]) -> list[str]:
    """Left-aligned columns under their titles."""
    widths = [max(map(len, col)) for col in zip(titles, *rows, strict=True)]
    line = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    return [line(titles), line(["-" * w for w in widths]), *map(line, rows)]
