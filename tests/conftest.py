"""A session for all tests, and a small index with known answers."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STAR = "/root/testdata/sf0.001"

ROWS = {
    "metadata": [("version", "1"), ("tool", "test-indexer"), ("project_root", "/test/project")],
    "index_state": [("abc123", 1700000000, "[]")],
    "documents": [(i, p, "swift", 1700000000) for i, p in enumerate(("Sources/MyClass.swift", "Sources/IMyProtocol.swift", "Sources/Assembly.swift", "Tests/MyClassTests.swift", "Tests/Mocks/MockMyClass.swift"), 1)],
    "symbols": [
        (1, "swift MyModule MyClass#", "class", "A sample class for testing.", 1),
        (2, "swift MyModule IMyProtocol#", "protocol", None, 2),
        (3, "swift MyModule MyClass#doSomething().", "function", None, 1),
        (4, "swift TestModule MockMyClass#", "class", None, 5),
    ],
    "relationships": [(1, "swift MyModule MyClass#", "swift MyModule IMyProtocol#", "conforms"), (2, "swift TestModule MockMyClass#", "swift MyModule IMyProtocol#", "conforms")],
    "occurrences": [
        (1, "swift MyModule MyClass#", 1, 10, 7, 10, 14, 1, None, "class MyClass: IMyProtocol {"),
        (2, "swift MyModule MyClass#", 3, 15, 20, 15, 27, 8, "swift MyModule Assembly#register().", "let instance = MyClass()"),
        (3, "swift MyModule MyClass#", 4, 5, 10, 5, 17, 8, "swift TestModule MyClassTests#", "var sut: MyClass!"),
        (4, "swift MyModule IMyProtocol#", 2, 5, 10, 5, 21, 1, None, "protocol IMyProtocol {"),
        (5, "swift MyModule MyClass#doSomething().", 1, 15, 10, 15, 21, 1, "swift MyModule MyClass#", "func doSomething() {"),
        (6, "swift TestModule MockMyClass#", 5, 3, 7, 3, 18, 1, None, "class MockMyClass: IMyProtocol {"),
    ],
}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def write_sqlite(path, rows=ROWS, skip=()):
    import sqlite3

    from lodestar.schema import SCHEMAS

    conn = sqlite3.connect(path)
    for t, schema in SCHEMAS.items():
        if t not in skip:
            conn.execute(f"create table {t} ({', '.join(f.name for f in schema)})")
            conn.executemany(f"insert into {t} values ({', '.join('?' * len(schema))})", rows.get(t, []))
    conn.commit()
    conn.close()
    return str(path)


@pytest.fixture(scope="session")
def sample(spark):
    from lodestar.index import CodeIndex

    return CodeIndex.from_rows(spark, ROWS).cached()


@pytest.fixture(scope="session")
def navigator(sample):
    from lodestar.service import Navigator

    return Navigator(sample)
