"""The operators as described tools: a list of input schemas, and a dispatcher that answers in JSON text."""

from __future__ import annotations

from typing import Any

from lodestar.render import to_json
from lodestar.service import Navigator

KINDS = ["class", "struct", "protocol", "enum", "function", "property"]


def _text(about: str, **more: Any) -> dict[str, Any]:
    return {"type": "string", "description": about, **more}


def _limit(default: int, most: int) -> dict[str, Any]:
    return {"type": "integer", "description": "How many results at most.", "default": default, "minimum": 1, "maximum": most}


def _tool(name: str, about: str, required: str, properties: dict[str, Any]) -> dict[str, Any]:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": properties, "required": [required]}}


def list_tools() -> list[dict[str, Any]]:
    return [
        _tool("go_to_definition", "Where a symbol is defined, with its supertypes and members.", "symbol", {"symbol": _text("Name of the symbol."), "file": _text("A file in which the symbol is used."), "line": {"type": "integer", "description": "The line there."}}),
        _tool("find_references", "Where a symbol is used.", "symbol", {"symbol": _text("Name of the symbol."), "include_definitions": {"type": "boolean", "description": "List definitions, too.", "default": False}, "limit": _limit(50, 200)}),
        _tool("find_implementations", "Which types conform to a protocol.", "protocol", {"protocol": _text("Name of the protocol."), "limit": _limit(50, 200)}),
        _tool("search_symbols", "Symbols by name, with * for any text.", "query", {"query": _text("What to look for."), "kind": _text("Only symbols of this kind.", enum=KINDS), "module": _text("Only symbols of this module."), "limit": _limit(25, 100)}),
    ]


def call_tool(navigator: Navigator, name: str, arguments: dict[str, Any]) -> str:
    """The answer as JSON text; ValueError for an unknown tool or a missing argument. Limits are not clamped."""
    required = {t["name"]: t["inputSchema"]["required"][0] for t in list_tools()}
    if name not in required:
        raise ValueError(f"Unknown tool: {name}")
    wanted = arguments.get(required[name])
    if not wanted:
        raise ValueError(f"{required[name]} is required")
    limit = int(arguments.get("limit", 25 if name == "search_symbols" else 50))
    if name == "go_to_definition":
        line = arguments.get("line")
        found = navigator.go_to_definition(wanted, arguments.get("file"), None if line is None else int(line))
        return to_json({"error": f"Symbol '{wanted}' not found"} if found is None else found)
    if name == "find_references":
        return to_json(navigator.find_references(wanted, bool(arguments.get("include_definitions", False)), limit))
    if name == "find_implementations":
        return to_json(navigator.find_implementations(wanted, limit))
    symbols = navigator.search_symbols(wanted, arguments.get("kind"), arguments.get("module"), limit)
    return to_json({"count": len(symbols), "symbols": symbols})
