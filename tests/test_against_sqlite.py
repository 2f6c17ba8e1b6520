"""Operators against the SQL they stand for, run by SQLite on random small indexes."""

import sqlite3

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestar.index import CodeIndex
from lodestar.operators import definition, references, search
from lodestar.plans import relations as R
from tests.conftest import write_sqlite

NAMES = st.sampled_from(["swift M A#", "swift M A#b().", "swift m ab#", "SWIFT M aB#", "swift N B_#", "local 1", "x"])
MAYBE = lambda s: st.one_of(st.none(), s)


@st.composite
def indexes(draw):
    many = lambda row, most: [(i, *r) for i, r in enumerate(draw(st.lists(row, max_size=most)))]
    line = st.integers(1, 4)
    spans = [(i, s, f, a, c, a + w, c + 1, r, e, t) for i, s, f, a, c, w, r, e, t in many(st.tuples(NAMES, st.integers(0, 3), line, line, st.integers(0, 2), st.integers(0, 15), MAYBE(NAMES), MAYBE(st.sampled_from(["", "t"]))), 14)]
    return {
        "documents": [(i, f"d{2 - i}", "swift", 0) for i in range(3)],
        "symbols": many(st.tuples(NAMES, MAYBE(st.sampled_from(["class", "protocol", "function"])), MAYBE(st.sampled_from(["", "doc"])), st.none()), 8),
        "relationships": many(st.tuples(NAMES, NAMES, st.sampled_from(["conforms", "implements", "inherits", "overrides"])), 8),
        "occurrences": spans,
    }


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(indexes())
def test_operators(spark, tmp_path_factory, rows):
    conn = sqlite3.connect(write_sqlite(tmp_path_factory.mktemp("ix") / "x.db", rows))
    sql = lambda q, *a: conn.execute(q, a).fetchall()
    ix = CodeIndex.from_rows(spark, rows).cached()
    got = lambda df: [tuple(r) for r in df.collect()]
    known = "from occurrences o join documents d on d.id = o.file_id"

    sites = {s: sql(f"select d.relative_path, o.start_line, o.start_column, o.snippet {known} where o.symbol_id = ? and o.roles & 1 != 0 order by o.start_line, o.id limit 1", s) for (s,) in sql("select distinct symbol_id from occurrences")}
    assert sorted(got(R.definition_sites(ix))) == sorted((s, *r[0]) for s, r in sites.items() if r)
    assert sorted(got(R.member_rows(ix)), key=repr) == sorted(sql("select distinct o.enclosing_symbol, o.symbol_id, s.kind from occurrences o join symbols s on s.symbol_id = o.symbol_id where o.enclosing_symbol is not null and o.roles & 1 != 0"), key=repr)
    assert sorted(got(R.implementers(ix)), key=repr) == sorted(sql("select distinct r.target_symbol_id, s.symbol_id, s.kind, r.kind from relationships r join symbols s on s.symbol_id = r.symbol_id where r.kind in ('conforms', 'implements', 'inherits')"), key=repr)
    for wanted in ("a", "B_", "%"):
        ranked = "case when symbol_id like ? then 0 else 1 end"
        assert got(definition.candidates(ix, wanted).select("symbol_id", "kind")) == sql(f"select symbol_id, kind from symbols where symbol_id like ? order by {ranked}, id limit 20", f"%{wanted}%", f"%{wanted}#")
        assert got(definition.candidates(ix, wanted, 3, True).select("symbol_id", "kind")) == sql(f"select symbol_id, kind from symbols where symbol_id like ? order by {ranked}, case when kind = 'protocol' then 0 else 1 end, id limit 3", f"%{wanted}%", f"%{wanted}#")
    a = "swift M A#"
    assert got(references.page(ix, a, limit=3).select("file", "line", "id")) == sql(f"select d.relative_path, o.start_line, o.id {known} where o.symbol_id = ? and o.roles & 1 = 0 order by 1, 2, 3 limit 3", a)
    assert got(references.count(ix, a)) == sql("select count(*) from occurrences where symbol_id = ? and roles & 1 = 0", a)
    order = "order by case when o.roles & 8 != 0 then 0 else 1 end, o.start_line desc, o.id limit 1"
    places = [(f"d{d}", n) for d in range(3) for n in range(1, 6)]
    best = {p: sql(f"select o.symbol_id {known} where d.relative_path = ? and o.start_line <= ? and o.end_line >= ? {order}", p[0], p[1], p[1]) for p in places}
    assert sorted(got(definition.at_positions(ix, spark.createDataFrame(places, "relative_path string, line int")))) == sorted((*p, r[0][0]) for p, r in best.items() if r)
    assert got(definition.at_position(ix, "d1", 2)) == best[("d1", 2)]
    rows_sql = "select s.symbol_id, s.kind, s.id, o.id from symbols s left join occurrences o on o.symbol_id = s.symbol_id and o.roles & 1 != 0 left join documents d on d.id = o.file_id where s.symbol_id like ? and s.symbol_id like ? order by case when s.symbol_id like ? then 0 else 1 end, s.symbol_id, s.id, o.id limit 5"
    assert got(search.rows(ix, "*b", module="m", limit=5).select("symbol_id", "kind", "sid", "oid")) == sql(rows_sql, "%%b%", "% m %", "%*b#")
    ix.documents.sparkSession.catalog.clearCache()
