import os

import duckdb
import pytest

import __spark_entry__
from lodestar.queries import ORACLE_SQL, QUERIES
from tests.conftest import STAR


@pytest.fixture(scope="module")
def duck():
    conn = duckdb.connect()
    for t in os.listdir(STAR):
        conn.execute(f"create view {t.removesuffix('.parquet')} as select * from '{STAR}/{t}'")
    return conn


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, STAR)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    answer = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == cols
    assert mine == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in answer.fetchall())


def test_tool_json(spark):
    assert '"kind":"function"' in QUERIES["q30_tool_json"](spark, STAR).where("symbol_id like '%make%'").first()["json"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
