from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import match
from lodestar.functions import symbols as S


def plain_name(x):
    if x.startswith("local "):
        return "local_" + x[6:]
    words = x
    for mark in ("#", ".", "()"):
        words = words.replace(mark, " ")
    words = words.split()
    return (words[-1].strip("`.") if words else "") or x


def plain_module(x):
    words = x.split()
    return words[1] if not x.startswith("local ") and len(words) > 1 and words[1] not in ("#", ".") else None


def like(pattern, text):
    """LIKE with A-Z folded, without an escape."""
    import sqlite3

    return bool(sqlite3.connect(":memory:").execute("select ? like ?", (text, pattern)).fetchone()[0])


IDS = ["swift M A#", "swift M A#b().", "local 42", "local ", "a", "", "  ", "swift # x", "s . y", "swift M `A`#", "swift M A#init(from:).", "#.()", "x y　z#", "swift Foo#", "``", "a `b`. ``"]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab #.()`l\t é", max_size=14), min_size=40, max_size=80))
def test_ids_are_parsed_as_plain_python_does(spark, more):
    ids = IDS + more
    got = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").select("i", S.name(F.col("x")).alias("n"), S.module(F.col("x")).alias("m")).orderBy("i").collect()
    assert [(r["n"], r["m"]) for r in got] == [(plain_name(x), plain_module(x)) for x in ids]


def test_members_and_roles(spark):
    r = spark.createDataFrame([("a", "function", 9), ("a", "class", 4), ("a", None, 0)], "n string, k string, r int")
    assert [x[0] for x in r.select(S.member(F.col("n"), F.col("k"))).collect()] == ["a()", "a", "a"]
    assert [x[0] for x in r.select(S.has_role(F.col("r"), 8)).collect()] == [True, False, False]


def test_location(spark):
    r = spark.createDataFrame([("f", 3, "c"), ("f", 4, ""), ("f", 5, None)], "f string, l int, c string")
    assert [x[0] for x in r.select(S.location(F.col("f"), F.col("l"), F.col("c"))).collect()] == ["f:3 (in c)", "f:4", "f:5"]


def test_like_folds_ascii_only_and_escapes_nothing(spark):
    texts = ["swift M A_b#", "SWIFT m aXb#", "É", "é", "a\\b", "a%b", "x#"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for wanted in ("a_b", "É", "\\", "%", "m", "a\\b"):
        got = [r[0] for r in df.select(match.contains(F.col("t"), wanted)).collect()]
        assert got == [like(f"%{wanted}%", t) for t in texts], wanted
        ranks = [r[0] for r in df.select(match.type_rank(F.col("t"), wanted)).collect()]
        assert ranks == [0 if like(f"%{wanted}#", t) else 1 for t in texts], wanted


def test_wildcards_are_not_anchored(spark):
    df = spark.createDataFrame([("swift M FooBar#",)], "t string")
    assert all(df.select(match.found(F.col("t"), q)).first()[0] for q in ("Foo*", "*Bar", "o*B", "*"))
