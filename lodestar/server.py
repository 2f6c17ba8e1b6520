"""The tools over standard input and output: JSON-RPC 2.0, a message a line."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import IO, Any

from pyspark.sql import SparkSession

from lodestar import config
from lodestar.service import Navigator
from lodestar.tools import call_tool, list_tools

PROTOCOL = "2024-11-05"
UNKNOWN_METHOD, BAD_MESSAGE = -32601, -32700


def answer(navigator: Callable[[], Navigator], message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to one message; None for a notification. navigator is called when a tool is, not before."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestar", "version": "1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": list_tools()}}
    if method == "tools/call":
        try:
            text, failed = call_tool(navigator(), params.get("name", ""), params.get("arguments") or {}), False
        except Exception as e:  # told to the caller; the server goes on
            text, failed = str(e), True
        return reply | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return reply | {"error": {"code": UNKNOWN_METHOD, "message": f"Unknown method: {method}"}}


def serve(navigator: Callable[[], Navigator], source: IO[str], sink: IO[str]) -> None:
    """Answer messages until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_MESSAGE, "message": str(e)}}
        else:
            reply = answer(navigator, message)
        if reply is not None:
            sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
            sink.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestar.server", description=__doc__)
    parser.add_argument("--db", help="database file, or folder of Parquet tables")
    parser.add_argument("--config", help="settings file")
    args = parser.parse_args(argv)
    settings = config.load(args.config, db_path=args.db)
    opened: list[Navigator] = []

    def navigator() -> Navigator:
        if not opened:
            nav = Navigator.open(SparkSession.builder.appName("lodestar").getOrCreate(), settings)
            opened.append(Navigator(nav.index.cached()))
        return opened[0]

    serve(navigator, sys.stdin, sys.stdout)
    return 0


if __name__ == "__main__":
    sys.exit(main())
