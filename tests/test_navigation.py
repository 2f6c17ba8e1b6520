from lodestar.index import CodeIndex
from lodestar.service import Navigator
from tests.conftest import ROWS


def test_definition_by_name(navigator):
    assert navigator.go_to_definition("MyClass") == {
        "symbol": "MyClass",
        "kind": "class",
        "module": "MyModule",
        "definition": {"file": "Sources/MyClass.swift", "line": 10, "column": 7, "snippet": "class MyClass: IMyProtocol {"},
        "conformances": ["IMyProtocol"],
        "members": ["doSomething()"],
        "documentation": "A sample class for testing.",
    }
    assert navigator.go_to_definition("IMyProtocol")["kind"] == "protocol"
    assert navigator.go_to_definition("NonExistent") is None


def test_definition_at_a_place(navigator):
    assert navigator.go_to_definition("anything", "Sources/Assembly.swift", 15)["symbol"] == "MyClass"
    assert navigator.go_to_definition("x", "Sources/MyClass.swift", 15)["symbol"] == "doSomething"
    assert navigator.go_to_definition("MyClass", "Sources/MyClass.swift", 0)["symbol"] == "MyClass"
    assert navigator.go_to_definition("MyClass", "Sources/Nowhere.swift", 3)["symbol"] == "MyClass"


def test_references(navigator):
    r = navigator.find_references("MyClass")
    assert r == {
        "symbol": "MyClass",
        "reference_count": 2,
        "references": [
            {"file": "Sources/Assembly.swift", "line": 15, "column": 20, "snippet": "let instance = MyClass()", "context": "register"},
            {"file": "Tests/MyClassTests.swift", "line": 5, "column": 10, "snippet": "var sut: MyClass!", "context": "MyClassTests"},
        ],
        "grouped_by_module": {"MyModule": 2},
    }
    assert navigator.find_references("MyClass", include_definitions=True)["reference_count"] == 3
    one = navigator.find_references("MyClass", limit=1)
    assert (len(one["references"]), one["reference_count"], one["grouped_by_module"]) == (1, 2, {"MyModule": 1})
    assert len(navigator.find_references("MyClass", limit=-1)["references"]) == 2
    assert navigator.find_references("MyClass", limit=0) == {"symbol": "MyClass", "reference_count": 2, "references": []}
    assert navigator.find_references("IMyProtocol") == {"symbol": "IMyProtocol", "reference_count": 0, "references": []}
    assert navigator.find_references("NonExistent") == {"symbol": "NonExistent", "reference_count": 0, "references": []}


def test_implementations(navigator):
    r = navigator.find_implementations("IMyProtocol")
    assert (r["protocol"], r["implementation_count"], [i["name"] for i in r["implementations"]]) == ("IMyProtocol", 2, ["MyClass", "MockMyClass"])
    first, second = r["implementations"]
    assert first["file"] == "Sources/MyClass.swift" and first["members_implemented"] == ["doSomething()"]
    assert "members_implemented" not in second
    assert navigator.find_implementations("NonExistent") == {"protocol": "NonExistent", "implementation_count": 0, "implementations": []}
    assert navigator.find_implementations("IMyProtocol", limit=1)["implementation_count"] == 1


def test_search(navigator):
    names = lambda *a, **k: [r["name"] for r in navigator.search_symbols(*a, **k)]
    assert names("MyClass") == ["MyClass", "MockMyClass", "doSomething"]
    assert "MockMyClass" in names("Mock")
    assert "IMyProtocol" in names("*Protocol")
    assert names("My*") == ["IMyProtocol", "MyClass", "doSomething", "MockMyClass"]
    assert names("*", kind="protocol") == ["IMyProtocol"]
    assert names("*", module="TestModule") == ["MockMyClass"]
    assert names("*", module="testmodule") == ["MockMyClass"]
    assert len(names("*", limit=1)) == 1
    assert names("nothing like it") == []


def test_status(navigator):
    assert navigator.get_metadata("version") == "1" and navigator.get_metadata("nonexistent") is None
    assert navigator.get_index_state() == {"last_commit_hash": "abc123", "last_indexed_at": 1700000000, "indexed_files": "[]"}
    s = navigator.status()
    assert (s["tool"], s["documents"], s["symbols"], s["occurrences"], s["relationships"]) == ("test-indexer", 5, 4, 6, 2)


def changed(spark, **more):
    return Navigator(CodeIndex.from_rows(spark, {t: ROWS[t] + more.get(t, []) for t in ROWS}))


def test_orphans_duplicates_and_empty_parts(spark):
    me = "swift MyModule MyClass#"
    nav = changed(
        spark,
        occurrences=[
            (10, me, 99, 1, 1, 1, 2, 1, None, "orphan"),  # a definition in an unknown file is no site
            (11, me, 98, 2, 1, 2, 2, 8, None, None),  # counted, never listed
            (12, me, 5, 40, 1, 60, 2, 1, None, ""),  # a second definition
            (13, me, 3, 16, 1, 16, 2, 2, "", ""),  # an import counts as a reference
        ],
        symbols=[(20, me, "struct", "", 1), (21, "swift Alone Thing#", None, "", None), (22, "lonely", "class", None, None)],
        relationships=[(30, "swift TestModule MockMyClass#", "swift MyModule IMyProtocol#", "inherits"), (31, me, "swift M Base#", "overrides"), (32, me, "swift M Base#", "inherits")],
    )
    d = nav.go_to_definition("MyClass")
    assert d["kind"] == "class" and d["definition"]["line"] == 10 and d["inherits"] == ["Base"] and d["conformances"] == ["IMyProtocol"]
    assert nav.go_to_definition("Thing") == {"symbol": "Thing", "kind": None, "module": "Alone"}
    assert nav.go_to_definition("lonely")["module"] is None
    r = nav.find_references("MyClass")
    assert r["reference_count"] == 4 and len(r["references"]) == 3
    assert {"file": "Sources/Assembly.swift", "line": 16, "column": 1} in r["references"]
    names = [i["name"] for i in nav.find_implementations("IMyProtocol")["implementations"]]
    assert names == ["MyClass", "MyClass", "MockMyClass", "MockMyClass"]  # two kinds of symbol, two kinds of edge
    assert len(nav.search_symbols("MyClass#", limit=3)) == 1  # limited before repeats go


def test_empty_index(spark):
    nav = Navigator(CodeIndex.from_rows(spark, {}))
    assert nav.get_index_state() is None and nav.status()["last_commit"] == "N/A" and nav.status()["version"] == "unknown"
    assert nav.search_symbols("*") == [] and nav.go_to_definition("x") is None
