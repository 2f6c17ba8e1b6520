"""Navigation queries over the star tables seen as an index, and the same questions in SQL.

Lists are joined to text in the results, so that both engines give flat columns. SQL texts share the relations `ix_*`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import render, storage
from lodestar.functions import match
from lodestar.functions import symbols as S
from lodestar.index import CodeIndex
from lodestar.operators import definition, implementations, references, search, status
from lodestar.plans import relations as R
from lodestar.schema import TABLES, Role
from lodestar.service import Navigator
from lodestar.sources.star import oracle_ctes, stored_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PART, NATION = "swift Mod7 Part7#", "swift Core INation3#"


def _name(x: str) -> str:
    return (
        f"case when starts_with({x}, 'local ') then 'local_' || substr({x}, 7) else coalesce(nullif(trim(list_extract(string_split_regex(trim(regexp_replace("
        f"replace(replace(replace({x}, '#', ' '), '.', ' '), '()', ' '), '\\s+', ' ', 'g')), ' '), -1), '`.'), ''), {x}) end"
    )


def _module(x: str) -> str:
    word = f"list_extract(string_split_regex(trim({x}), '\\s+'), 2)"
    return f"case when not starts_with({x}, 'local ') and {word} not in ('#', '.') then {word} end"


def _fold(x: str) -> str:
    return f"translate({x}, '{match.UPPER}', '{match.LOWER}')"


def _like(x: str, pattern: str) -> str:
    return f"{_fold(x)} like {_fold(repr(pattern))}"


def _rank(x: str, wanted: str) -> str:
    return f"case when {_like(x, '%' + wanted + '#')} then 0 else 1 end"


SITES = "select symbol_id, file, line, col, snippet from (select o.symbol_id, relative_path file, start_line line, start_column col, snippet, row_number() over (partition by o.symbol_id order by start_line, o.id) k from ix_occurrences o join ix_documents d on d.id = file_id where roles & 1 <> 0) where k = 1"
MEMBERS = f"select enclosing_symbol owner, string_agg(case when kind = 'function' then n || '()' else n end, ',' order by symbol_id) members from (select distinct enclosing_symbol, o.symbol_id, kind, {_name('o.symbol_id')} n from ix_occurrences o join ix_symbols s using (symbol_id) where roles & 1 <> 0 and enclosing_symbol is not null) group by 1"
EDGES = f"select symbol_id, string_agg(n, ',' order by id) filter (where kind = 'inherits') inherits, string_agg(n, ',' order by id) filter (where kind <> 'inherits') conformances from (select *, {_name('target_symbol_id')} n from ix_relationships where kind in ('conforms', 'implements', 'inherits')) group by 1"
FIRST = "select symbol_id, kind, documentation from (select *, row_number() over (partition by symbol_id order by id) k from ix_symbols) where k = 1"
DEFINED = f"select symbol_id, {_name('symbol_id')} symbol, kind, {_module('symbol_id')} as module, file, line, col as column_, snippet, inherits, conformances, members, documentation from first left join sites using (symbol_id) left join edges using (symbol_id) left join members on owner = symbol_id"
IMPLEMENTERS = "select distinct target_symbol_id target, s.symbol_id, s.kind, r.kind relationship_kind from ix_relationships r join ix_symbols s using (symbol_id) where r.kind in ('conforms', 'implements', 'inherits')"
IMPLEMENTED = f"select i.*, {_name('i.symbol_id')} as name, {_module('i.symbol_id')} as module, file, line, nullif(snippet, '') snippet, members from implementers i left join sites using (symbol_id) left join members on owner = i.symbol_id"


def _sql(body: str) -> str:
    parts = {"sites": SITES, "members": MEMBERS, "edges": EDGES, "first": FIRST, "implementers": IMPLEMENTERS, "defined": DEFINED, "implemented": IMPLEMENTED}
    return f"with {oracle_ctes()},\n" + ",\n".join(f"{k} as ({v})" for k, v in parts.items()) + f"\n{body}"


def query(sql: str | None = None):
    """Register the function under its name, without the leading underscore; it takes an index."""

    def add(fn: Callable[[CodeIndex], DataFrame]):
        key = fn.__name__.lstrip("_")
        QUERIES[key] = lambda spark, folder: fn(stored_index(spark, folder))
        if sql:
            ORACLE_SQL[key] = _sql(sql)
        return fn

    return add


def _text(df: DataFrame, *lists: str) -> DataFrame:
    """Lists joined by commas; `column` under a name that is no keyword."""
    df = df.withColumns({c: F.nullif(F.array_join(c, ","), F.lit("")) for c in lists})
    return df.withColumnRenamed("column", "column_")


DEFINITION_LISTS = ("inherits", "conformances", "members")


@query("select * from implemented")
def q18_implementations_full(ix):
    return _text(implementations.implementations(ix).withColumnRenamed("members_implemented", "members"), "members")


@query(f"select symbol_id, {_name('symbol_id')} as name from ix_symbols")
def q01_symbol_names(ix):
    return ix.symbols.select("symbol_id", S.name(F.col("symbol_id")).alias("name"))


@query(f"select symbol_id, {_module('symbol_id')} as module from ix_symbols")
def q02_symbol_modules(ix):
    return ix.symbols.select("symbol_id", S.module(F.col("symbol_id")).alias("module"))


@query(f"select distinct enclosing_symbol owner, o.symbol_id, case when kind = 'function' then {_name('o.symbol_id')} || '()' else {_name('o.symbol_id')} end label from ix_occurrences o join ix_symbols s using (symbol_id) where roles & 1 <> 0 and enclosing_symbol is not null")
def q03_member_display(ix):
    return R.member_rows(ix).select("owner", "symbol_id", S.member(S.name(F.col("symbol_id")), F.col("kind")).alias("label"))


@query("select bit, count(*) n from ix_occurrences, (select unnest([1, 2, 4, 8, 16, 32]) bit) where roles & bit <> 0 group by bit")
def q04_role_breakdown(ix):
    bits = (Role.DEFINITION, Role.IMPORT, Role.WRITE_ACCESS, Role.READ_ACCESS, Role.GENERATED, Role.TEST)
    row = ix.occurrences.agg(*(F.count_if(S.has_role(F.col("roles"), b)).alias(f"b{b}") for b in bits))
    return row.select(F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.col(f"b{b}").alias("n")) for b in bits))).alias("r")).select("r.*").where("n > 0")


REFS = f"select symbol_id, relative_path file, start_line line, start_column column_, nullif(snippet, '') snippet, case when enclosing_symbol <> '' then {_name('enclosing_symbol')} end context, o.id from ix_occurrences o join ix_documents d on d.id = file_id"


@query(f"select * from ({REFS} where roles & 1 = 0 and symbol_id = '{PART}') order by file, line, id limit 50")
def q05_reference_page(ix):
    return _text(references.page(ix, PART))


@query("select symbol_id, count(*) reference_count from ix_occurrences where roles & 1 = 0 group by 1")
def q06_reference_counts(ix):
    return references.counts(ix)


@query(f"select * from ({REFS} where symbol_id = '{PART}') order by file, line, id limit 20")
def q07_reference_page_with_definitions(ix):
    return _text(references.page(ix, PART, True, 20))


@query(f"select coalesce({_module('symbol_id')}, 'Unknown') as module, count(*) reference_count from ix_occurrences o join ix_documents d on d.id = file_id where roles & 1 = 0 group by 1")
def q08_references_by_module(ix):
    return references.by_module(ix)


@query(f"select file, context, count(*) n from ({REFS} where roles & 1 = 0) group by all")
def q09_reference_context(ix):
    return references.pages(ix).groupBy("file", "context").agg(F.count(F.lit(1)).alias("n"))


@query("select symbol_id, file, line, col as column_, snippet from sites")
def q10_definition_sites(ix):
    return _text(R.definition_sites(ix))


@query(f"select * from defined where symbol_id = (select symbol_id from ix_symbols where {_like('symbol_id', '%part7%')} order by {_rank('symbol_id', 'part7')}, id limit 1)")
def q11_definition_by_name(ix):
    return _text(definition.by_name(ix, "part7"), *DEFINITION_LISTS)


@query("select * from defined")
def q12_definition_by_id(ix):
    return _text(definition.definitions(ix), *DEFINITION_LISTS)


AT = "order by case when roles & 8 <> 0 then 0 else 1 end, start_line desc, o.id"


@query(f"select symbol_id from ix_occurrences o join ix_documents d on d.id = file_id where relative_path = (select min(relative_path) from ix_documents d join ix_occurrences o on d.id = file_id where start_line = 10 and end_line > 10) and start_line <= 11 and end_line >= 11 {AT} limit 1")
def q13_symbol_at_position(ix):
    return definition.at_position(ix, _some_path(ix), 11)


def _some_path(ix) -> Column:
    """The first path with an occurrence from line 10 on."""
    return definition.covering(ix).where("start_line = 10 and end_line > 10").agg(F.min("relative_path")).scalar()


PLACES = "select distinct relative_path, x.line from ix_documents, (select unnest([1, 5, 11, 21, 40]) as line) x"


@query(f"select relative_path, line, symbol_id from (select relative_path, line, symbol_id, row_number() over (partition by relative_path, line {AT}) k from ({PLACES}) join ix_documents d using (relative_path) join ix_occurrences o on d.id = file_id and start_line <= line and end_line >= line) where k = 1")
def q14_symbol_at_positions(ix):
    places = ix.documents.select("relative_path", F.explode(F.array(*map(F.lit, (1, 5, 11, 21, 40)))).alias("line"))
    return definition.at_positions(ix, places)


@query("select * from members")
def q15_members(ix):
    return _text(R.members(ix), "members")


@query("select * from edges")
def q16_edges_split(ix):
    return _text(R.edges(ix), "inherits", "conformances")


@query("select * from implementers")
def q17_implementers(ix):
    return R.implementers(ix)


@query(f"select symbol_id, relationship_kind, name, kind, module, file, line, snippet, members from implemented where target = '{NATION}' order by symbol_id, kind, relationship_kind limit 50")
def q18_implementations_page(ix):
    return _text(implementations.of_target(ix, NATION).withColumnRenamed("members_implemented", "members"), "members")


@query(f"select symbol_id, kind, {_rank('symbol_id', 'INation3')} rank from ix_symbols where {_like('symbol_id', '%INation3%')} order by rank, case when kind = 'protocol' then 0 else 1 end, id limit 5")
def q19_protocol_candidates(ix):
    return definition.candidates(ix, "INation3", 5, protocols_first=True).select("symbol_id", "kind", "rank")


@query(f"select symbol_id, kind, {_rank('symbol_id', 'supplier1')} rank from ix_symbols where {_like('symbol_id', '%supplier1%')} order by rank, id limit 20")
def q20_reference_candidates(ix):
    return definition.candidates(ix, "supplier1").select("symbol_id", "kind", "rank")


def _search(where: str, query: str, limit: int) -> str:
    rows = f"select s.symbol_id, kind, nullif(relative_path, '') file, case when nullif(relative_path, '') is not null then start_line end line, nullif(snippet, '') snippet, {_rank('s.symbol_id', query)} rank, s.id sid, o.id oid from ix_symbols s left join ix_occurrences o on o.symbol_id = s.symbol_id and roles & 1 <> 0 left join ix_documents d on d.id = o.file_id where {where} order by rank, s.symbol_id, sid, oid nulls first limit {limit}"
    return f"select symbol_id, {_name('symbol_id')} as name, kind, {_module('symbol_id')} as module, file, line, snippet from (select *, row_number() over (partition by symbol_id order by sid, oid nulls first) k from ({rows})) where k = 1"


@query(_search(_like("s.symbol_id", "%part1%"), "part1", 25))
def q21_search_plain(ix):
    return search.search(ix, "part1")


@query(_search(_like("s.symbol_id", "%Part%make1%"), "Part*make1", 40))
def q22_search_wildcard(ix):
    return search.search(ix, "Part*make1", limit=40)


@query(_search(_like("s.symbol_id", "%2%") + " and kind = 'protocol'", "2", 25))
def q23_search_kind(ix):
    return search.search(ix, "2", kind="protocol")


@query(_search(_like("s.symbol_id", "%1%") + " and " + _like("s.symbol_id", "% MOD3 %"), "1", 25))
def q24_search_module(ix):
    return search.search(ix, "1", module="MOD3")


@query(_search(_like("s.symbol_id", "%Part7_#%"), "Part7_#", 9))
def q25_search_dedupe(ix):
    return search.search(ix, "Part7_#", limit=9)


@query(" union all ".join(f"select '{t}' relation, count(*) n from ix_{t}" for t in status.COUNTED))
def q26_status_counts(ix):
    return status.counts(ix)


@query("select " + ", ".join(f"coalesce(max(value) filter (where key = '{k}'), 'unknown') {k}" for k in status.KEYS) + " from ix_metadata")
def q27_metadata_lookup(ix):
    return status.summary(ix)


@query("select * from ix_index_state limit 1")
def q28_index_state(ix):
    return status.state(ix)


def q29_schema_tables(spark, folder):
    """Which tables of an index a catalogue has: that of the star tables, where most are missing, and of the stored index."""
    there = storage.catalogue(spark, folder)
    stored = storage.catalogue(spark, stored_index(spark, folder).symbols.inputFiles()[0].rsplit("/", 2)[0])
    return spark.createDataFrame([(t, t in there, t in stored) for t in sorted(TABLES)], "name string, in_star boolean, in_index boolean")


QUERIES["q29_schema_tables"] = q29_schema_tables
ORACLE_SQL["q29_schema_tables"] = "select name, name in (select table_name from information_schema.tables) in_star, true in_index from (select unnest(['" + "', '".join(sorted(TABLES)) + "']) as name)"


def _json(fields: dict[str, str]) -> str:
    """SQL for an object of those fields whose value is not null."""
    return "'{' || concat_ws(',', " + ", ".join(f"""'"{k}":' || to_json({v})""" for k, v in fields.items()) + ") || '}'"


_SITE = _json({"file": "file", "line": "line", "column": "column_", "snippet": "snippet"})
_RECORD = "'{' || concat_ws(',', '\"symbol\":' || to_json(symbol), '\"kind\":' || to_json(kind), '\"module\":' || to_json(module), case when line is not null then '\"definition\":' || " + _SITE + " end, " + ", ".join(f"""'"{k}":' || to_json(string_split({k}, ','))""" for k in DEFINITION_LISTS) + ", '\"documentation\":' || to_json(nullif(documentation, ''))) || '}'"


@query(f"select symbol_id, {_RECORD} as json from defined")
def q30_tool_json(ix):
    """A record of each definition as JSON, with empty parts left out."""
    d = definition.definitions(ix)
    site = F.when(F.col("line").isNotNull(), F.struct("file", "line", "column", "snippet"))
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    record = F.struct("symbol", "kind", "module", site.alias("definition"), *(full(c).alias(c) for c in DEFINITION_LISTS), F.nullif(F.col("documentation"), F.lit("")).alias("documentation"))
    return d.select("symbol_id", F.to_json(record).alias("json"))


@query(f"select symbol_id, file || ':' || line || coalesce(' (in ' || context || ')', '') as place, id from ({REFS} where roles & 1 = 0)")
def q31_locations(ix):
    p = references.pages(ix)
    return p.select("symbol_id", S.location(F.col("file"), F.col("line"), F.col("context")).alias("place"), "id")


@query(f"select owner, list_aggregate(list_slice(string_split(members, ','), 1, {render.SHOWN}), 'string_agg', ', ') shown, greatest(len(string_split(members, ',')) - {render.SHOWN}, 0)::int more from members")
def q32_member_truncation(ix):
    m = R.members(ix)
    return m.select("owner", F.array_join(F.slice("members", 1, render.SHOWN), ", ").alias("shown"), F.greatest(F.size("members") - render.SHOWN, F.lit(0)).alias("more"))


_PATH = "(select min(relative_path) from ix_documents d join ix_occurrences o on d.id = file_id where start_line = 10 and end_line > 10)"
_LOST = "(select min(relative_path) from ix_documents d join ix_occurrences o on d.id = file_id where symbol_id like 'swift Gone %')"
_NAMED = f"(select symbol_id from ix_symbols where {_like('symbol_id', '%part7%')} order by {_rank('symbol_id', 'part7')}, id limit 1)"


def _go_to(case: str, path: str, line: int) -> str:
    rows = f"select o.symbol_id from ix_occurrences o join ix_documents d on d.id = file_id where relative_path = {path} and start_line <= {line} and end_line >= {line} {AT} limit 1"
    return f"select '{case}' as case_, * from defined where symbol_id = coalesce(({rows}), {_NAMED})"


@query(" union all ".join([_go_to("place", _PATH, 11), f"select 'line 0', * from defined where symbol_id = {_NAMED}", _go_to("nothing there", _PATH, 100000), _go_to("unknown", _LOST, 900)]))
def q33_go_to_definition(ix):
    """By place, by name as there is no line 0, by name as nothing is at the place, and a place whose symbol is unknown (no row)."""
    lost = definition.covering(ix).where(F.col("symbol_id").startswith("swift Gone ")).agg(F.min("relative_path")).scalar()
    cases = {"place": (_some_path(ix), 11), "line 0": (_some_path(ix), 0), "nothing there": (_some_path(ix), 100_000), "unknown": (lost, 900)}
    wanted = reduce(DataFrame.unionByName, (definition.wanted_symbol(ix, "part7", *place).withColumn("case_", F.lit(case)) for case, place in cases.items()))
    return _text(definition.definitions(ix, wanted).join(F.broadcast(wanted), "symbol_id"), *DEFINITION_LISTS)


@query("select '1' as version, 'unknown' as tool, 'unknown' as project_root, (select count(*) from ix_metadata where key = 'nope') found")
def q34_metadata_missing(ix):
    few = replace(ix, metadata=ix.metadata.where("key = 'version'"))
    return status.summary(few).withColumn("found", status.metadata(ix, "nope").agg(F.count(F.lit(1))).scalar())


@query(_search(_like("s.symbol_id", "%2%"), "2", 1 << 40))
def q35_search_without_limit(ix):
    return search.search(ix, "2", limit=-1)


@query("select symbol_id, count(*) reference_count from ix_occurrences group by 1")
def q36_reference_counts_with_definitions(ix):
    return references.counts(ix, True)


@query("select value from ix_metadata where key = 'tool'")
def q37_metadata_value(ix):
    return status.metadata(ix, "tool")


def answer(sql: str):
    """Register a call of the service under the function's name: one row, its answer as JSON."""

    def add(fn: Callable[[Navigator], object]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            found = fn(Navigator(stored_index(spark, folder)))
            return spark.createDataFrame([(json.dumps(found, separators=(",", ":"), ensure_ascii=False),)], "json string")

        QUERIES[fn.__name__] = run
        ORACLE_SQL[fn.__name__] = _sql(sql)
        return fn

    return add


def _list(row: str, rows: str, order: str) -> str:
    return f"(select '[' || coalesce(string_agg({row}, ',' order by {order}), '') || ']' from ({rows}))"


_REFERENCE = _json({"file": "file", "line": "line", "column": "column_", "snippet": "snippet", "context": "context"})
_PAGE = f"{REFS} where roles & 1 = 0 and symbol_id = {_NAMED} order by file, line, id limit 3"


@answer(
    f"select '{{\"symbol\":' || to_json({_name('s')}) || ',\"reference_count\":' || (select count(*) from ix_occurrences where roles & 1 = 0 and symbol_id = s) || ',\"references\":' || {_list(_REFERENCE, _PAGE, 'file, line, id')}"
    f" || ',\"grouped_by_module\":{{' || to_json({_module('s')}) || ':' || (select count(*) from ({_PAGE})) || '}}}}' as json from (select {_NAMED} as s)"
)
def q38_answer_references(nav):
    return nav.find_references("part7", limit=3)


_IMPLEMENTATION = _json({"name": "name", "kind": "kind", "module": "module", "file": "file", "line": "line", "snippet": "snippet", "members_implemented": "string_split(members, ',')"})
_FEW = f"select * from implemented where target = (select symbol_id from ix_symbols where {_like('symbol_id', '%INation3%')} order by {_rank('symbol_id', 'INation3')}, case when kind = 'protocol' then 0 else 1 end, id limit 1) order by symbol_id, kind, relationship_kind limit 4"


@answer(f"select '{{\"protocol\":\"INation3\",\"implementation_count\":' || (select count(*) from ({_FEW})) || ',\"implementations\":' || {_list(_IMPLEMENTATION, _FEW, 'symbol_id, kind, relationship_kind')} || '}}' as json")
def q39_answer_implementations(nav):
    return nav.find_implementations("INation3", 4)


_FOUND = _search(_like("s.symbol_id", "%part1%"), "part1", 6)
_MATCH = _json({"name": "name", "kind": "kind", "module": "module", "file": "file", "line": "line", "snippet": "snippet"})


@answer(f"select {_list(_MATCH, _FOUND, _rank('symbol_id', 'part1') + ', symbol_id')} as json")
def q40_answer_search(nav):
    return nav.search_symbols("part1", limit=6)


_WHERE = "(select o.symbol_id from ix_occurrences o join ix_documents d on d.id = file_id where relative_path = 'none' limit 1)"


@answer(f"select {_RECORD} as json from defined where symbol_id = coalesce({_WHERE}, {_NAMED})")
def q41_answer_definition(nav):
    return nav.go_to_definition("part7", "none", 3)


@answer("select '{\"version\":\"1\",\"tool\":\"star\",\"project_root\":\"/star\",\"last_commit\":\"abc123\",\"last_indexed\":1700000000' || " + " || ".join(f"',\"{t}\":' || (select count(*) from ix_{t})" for t in status.COUNTED) + " || '}' as json")
def q42_answer_status(nav):
    return nav.status()
