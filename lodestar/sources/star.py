"""An order-and-parts star schema seen as a code index, and the same in SQL.

Orders are files, parts types with a method each, suppliers types of a module, nations and regions protocols, every tenth
customer a local symbol; line items are occurrences. Every 97th order is left out of the documents, so that some
occurrences, definitions among them, stand in unknown files; each region has an occurrence of a symbol that is not in the
index. Expressions are valid in Spark SQL and in DuckDB alike.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from lodestar import storage
from lodestar.index import CodeIndex

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

_PART = "'swift Mod' || cast(p_partkey % 25 as {text}) || ' Part' || cast(p_partkey as {text}) || '#'"
_METHOD = _PART + " || 'make' || cast(p_size as {text}) || '().'"
_SUPPLIER = "'swift Mod' || cast(s_nationkey as {text}) || ' Supplier' || cast(s_suppkey as {text}) || '#'"
_NATION = "'swift Core INation' || cast({key} as {{text}}) || '#'"
_REGION = "'swift Core IRegion' || cast({key} as {{text}}) || '#'"

TABLES = {
    "metadata": "select 'version' as key, '1' as value union all select 'tool', 'star' union all select 'project_root', '/star'",
    "index_state": "select 'abc123' as last_commit_hash, cast(1700000000 as bigint) as last_indexed_at, '[]' as indexed_files",
    "documents": "select o_orderkey as id, 'Sources/Mod' || cast(o_custkey % 25 as {text}) || '/Order' || cast(o_orderkey as {text}) || '.swift' as relative_path, 'swift' as language, cast(1700000000 as bigint) as indexed_at from {orders} where o_orderkey % 97 <> 0",
    "symbols": f"""
        select p_partkey * 8 as id, {_PART} as symbol_id, case p_partkey % 3 when 0 then 'class' when 1 then 'struct' else 'enum' end as kind, case when p_partkey % 5 = 0 then p_type end as documentation, p_partkey as file_id from {{part}}
        union all select p_partkey * 8 + 1, {_METHOD}, 'function', cast(null as {{text}}), p_partkey from {{part}}
        union all select s_suppkey * 8 + 2, {_SUPPLIER}, 'class', cast(null as {{text}}), s_suppkey from {{supplier}}
        union all select cast(n_nationkey as bigint) * 8 + 3, {_NATION.format(key="n_nationkey")}, 'protocol', cast(null as {{text}}), cast(null as bigint) from {{nation}}
        union all select cast(r_regionkey as bigint) * 8 + 4, {_REGION.format(key="r_regionkey")}, 'protocol', n.r_name, cast(null as bigint) from {{region}} n
        union all select c_custkey * 8 + 5, 'local ' || cast(c_custkey as {{text}}), 'property', cast(null as {{text}}), cast(null as bigint) from {{customer}} where c_custkey % 10 = 0""",
    "relationships": f"""
        select s_suppkey * 8 as id, {_SUPPLIER} as symbol_id, {_NATION.format(key="s_nationkey")} as target_symbol_id, case s_suppkey % 3 when 0 then 'conforms' when 1 then 'implements' else 'inherits' end as kind from {{supplier}}
        union all select p_partkey * 8 + 1, {_PART}, {_NATION.format(key="p_partkey % 25")}, 'conforms' from {{part}} where p_partkey % 4 = 0
        union all select p_partkey * 8 + 2, {_PART}, {_NATION.format(key="p_partkey % 25")}, 'inherits' from {{part}} where p_partkey % 12 = 0
        union all select p_partkey * 8 + 3, {_PART}, {_REGION.format(key="p_partkey % 5")}, 'overrides' from {{part}} where p_partkey % 6 = 0
        union all select cast(n_nationkey as bigint) * 8 + 4, {_NATION.format(key="n_nationkey")}, {_REGION.format(key="n_regionkey")}, 'inherits' from {{nation}}""",
    "occurrences": f"""
        select (l_orderkey * 64 + l_linenumber) * 1048576 + l_partkey as id, {_PART} as symbol_id, l_orderkey as file_id, l_linenumber * 10 as start_line, cast(l_quantity as int) as start_column, l_linenumber * 10 + cast(l_orderkey % 12 as int) as end_line, cast(l_quantity as int) + 4 as end_column, case l_returnflag when 'R' then 8 when 'A' then 4 else 10 end as roles, case when l_orderkey % 3 = 0 then {_SUPPLIER.replace("s_nationkey", "l_suppkey % 25").replace("s_suppkey", "l_suppkey")} when l_orderkey % 3 = 1 then '' end as enclosing_symbol, case when l_linenumber % 2 = 0 then 'let x = ' || cast(l_partkey as {{text}}) end as snippet from {{lineitem}} join {{part}} on l_partkey = p_partkey
        union all select (p_partkey * 64 + 48) * 1048576, {_PART}, p_partkey, 1, 7, 1, 20, 1, cast(null as {{text}}), 'struct Part' from {{part}}
        union all select (p_partkey * 64 + 49) * 1048576, {_METHOD}, p_partkey, 2, 10, 2, 24, 1, {_PART}, 'func make()' from {{part}}
        union all select (p_partkey * 64 + 50) * 1048576, {_PART}, p_partkey + 1, 5, 1, 6, 9, 17, cast(null as {{text}}), '' from {{part}} where p_partkey % 7 = 0
        union all select (s_suppkey * 64 + 51) * 1048576, {_SUPPLIER}, s_suppkey * 4, 3, 7, 3, 30, 1, cast(null as {{text}}), 'class Supplier' from {{supplier}}
        union all select (cast(n_nationkey as bigint) * 64 + 52) * 1048576, {_NATION.format(key="n_nationkey")}, cast(n_nationkey as bigint), 9, 10, 9, 30, 1, cast(null as {{text}}), cast(null as {{text}}) from {{nation}}
        union all select (cast(r_regionkey as bigint) * 64 + 53) * 1048576, 'swift Gone Lost' || cast(r_regionkey as {{text}}) || '#', cast(r_regionkey as bigint) + 1, 900, 1, 900, 9, 8, cast(null as {{text}}), cast(null as {{text}}) from {{region}}""",
}


def _filled(table: str, text: str, names: dict[str, str]) -> str:
    return TABLES[table].format(text=text, **names)


def oracle_ctes() -> str:
    """`ix_<table> as (...)` for each relation, for DuckDB over the star tables."""
    names = {t: t for t in STAR}
    return ",\n".join(f"ix_{t} as ({_filled(t, 'varchar', names)})" for t in TABLES)


def star_index(spark: SparkSession, folder: str) -> CodeIndex:
    """The index over `folder/<star table>.parquet`."""
    names = {t: f"parquet.`{folder}/{t}.parquet`" for t in STAR}
    return CodeIndex.from_frames({t: spark.sql(_filled(t, "string", names)) for t in TABLES})


def stored_index(spark: SparkSession, folder: str) -> CodeIndex:
    """The same index as CodeIndex.write() stores it, written once a session and folder: an index is built once and asked
    often. It is written anew if the star tables change or the stored one is gone."""
    state = storage.version(spark, [f"{folder}/{t}.parquet" for t in STAR])
    path = f"{storage.session_dir(spark)}/index-{hashlib.sha256(f'{folder}\n{state}'.encode()).hexdigest()[:16]}"
    if not storage.exists(spark, f"{path}/done"):
        star_index(spark, folder).write(path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return CodeIndex.from_parquet(spark, path)
