"""Command line: status, search, definition, references."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestar import config, render
from lodestar.service import Navigator


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, what, limit in (("status", None, None), ("search", "query", 25), ("definition", "symbol", None), ("references", "symbol", 50)):
        c = commands.add_parser(name)
        if what:
            c.add_argument("wanted", metavar=what)
        c.add_argument("--db", help="database file, or folder of Parquet tables")
        c.add_argument("--config", "-c", help="settings file")
        if limit:
            c.add_argument("--limit", "-n", type=int, default=limit)
        if name == "search":
            c.add_argument("--kind", "-k")
    return parser.parse_args(argv)


def lines(navigator: Navigator, args: argparse.Namespace, path: str) -> list[str]:
    if args.command == "status":
        s = navigator.status()
        titles = {"Database Path": path, "Schema Version": s["version"], "Indexer Tool": s["tool"], "Project Root": s["project_root"], "Last Commit": s["last_commit"], "Last Indexed": s["last_indexed"]}
        titles |= {t.capitalize(): s[t] for t in ("documents", "symbols", "occurrences", "relationships")}
        return render.grid(["Field", "Value"], [[k, str(v)] for k, v in titles.items()])
    if args.command == "search":
        found = navigator.search_symbols(args.wanted, kind=args.kind, limit=args.limit)
        if not found:
            return [f"No symbols found matching '{args.wanted}'"]
        return render.grid(["Name", "Kind", "Module", "File", "Line"], [[str(r.get(k) or "") for k in ("name", "kind", "module", "file", "line")] for r in found])
    if args.command == "definition":
        record = navigator.go_to_definition(args.wanted)
        return render.definition_lines(record) if record else [f"Symbol '{args.wanted}' not found"]
    record = navigator.find_references(args.wanted, limit=args.limit)
    return render.reference_lines(record) if record["reference_count"] else [f"No references found for '{args.wanted}'"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    settings = config.load(args.config, db_path=args.db)
    if not settings.db_path.exists():
        print(f"Database not found: {settings.db_path}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    print("\n".join(lines(Navigator.open(spark, settings), args, str(settings.db_path))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
