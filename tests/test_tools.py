import json

import pytest

from lodestar import render
from lodestar.tools import call_tool, list_tools


def test_list():
    tools = {t["name"]: t["inputSchema"] for t in list_tools()}
    assert list(tools) == ["go_to_definition", "find_references", "find_implementations", "search_symbols"]
    limits = {n: s["properties"]["limit"] for n, s in tools.items() if "limit" in s["properties"]}
    assert {n: (x["default"], x["minimum"], x["maximum"]) for n, x in limits.items()} == {"find_references": (50, 1, 200), "find_implementations": (50, 1, 200), "search_symbols": (25, 1, 100)}


def test_calls(navigator):
    ask = lambda name, **a: json.loads(call_tool(navigator, name, a))
    assert ask("go_to_definition", symbol="MyClass")["definition"]["line"] == 10
    assert ask("go_to_definition", symbol="x", file="Sources/Assembly.swift", line="15")["symbol"] == "MyClass"
    assert "not found" in ask("go_to_definition", symbol="zzz")["error"]
    assert ask("find_references", symbol="MyClass", include_definitions=True, limit=2)["reference_count"] == 3
    assert ask("find_implementations", protocol="IMyProtocol")["implementation_count"] == 2
    assert ask("search_symbols", query="My*", kind="class") == {"count": 2, "symbols": ask("search_symbols", query="My*", kind="class")["symbols"]}


@pytest.mark.parametrize(("name", "arguments", "said"), [("go_to_definition", {}, "symbol is required"), ("find_references", {"symbol": ""}, "symbol is required"), ("find_implementations", {}, "protocol is required"), ("search_symbols", {}, "query is required"), ("nothing", {"symbol": "x"}, "Unknown tool")])
def test_errors(navigator, name, arguments, said):
    with pytest.raises(ValueError, match=said):
        call_tool(navigator, name, arguments)


def test_long_member_lists_are_cut_short():
    lines = render.definition_lines({"symbol": "A", "kind": "class", "members": [f"m{i}" for i in range(13)]})
    assert lines[-1].strip() == "... and 3 more" and lines[-2].endswith("m9")


def test_json_keeps_letters():
    assert "é" in render.to_json({"a": "é"})


def test_messages(navigator):
    import io

    from lodestar.server import serve

    ask = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "x"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "search_symbols", "arguments": {"query": "Mock"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search_symbols"}},
        {"jsonrpc": "2.0", "id": 5, "method": "nothing"},
    ]
    out = io.StringIO()
    serve(lambda: navigator, io.StringIO("\n".join(map(json.dumps, ask)) + "\n\nno json\n"), out)
    said = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in said] == [1, 2, 3, 4, 5, None]
    assert said[0]["result"]["protocolVersion"] == "x" and len(said[1]["result"]["tools"]) == 4
    assert json.loads(said[2]["result"]["content"][0]["text"])["count"] == 1 and not said[2]["result"]["isError"]
    assert said[3]["result"]["isError"] and "error" in said[4] and "error" in said[5]
