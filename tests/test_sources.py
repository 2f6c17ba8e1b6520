import re
import sqlite3
from pathlib import Path

import pytest

from lodestar import cli, config
from lodestar.index import CodeIndex
from lodestar.schema import SCHEMAS, Role, SchemaError
from lodestar.service import Navigator
from lodestar.sources import sqlite
from tests.conftest import ROWS, write_sqlite


def test_a_database_file_gives_the_same_index(spark, navigator, tmp_path):
    path = write_sqlite(tmp_path / "index.db")
    nav = Navigator.open(spark, config.load(db_path=path))
    for t in SCHEMAS:
        assert sorted(map(tuple, getattr(nav.index, t).collect()), key=repr) == sorted(ROWS[t], key=repr)
    assert nav.go_to_definition("MyClass") == navigator.go_to_definition("MyClass")
    assert nav.find_implementations("IMyProtocol") == navigator.find_implementations("IMyProtocol")


def test_a_database_file_is_read_in_parts(spark, tmp_path, monkeypatch):
    path = write_sqlite(tmp_path / "index.db")
    monkeypatch.setattr(sqlite, "SPAN", 2)
    reader = sqlite.TableReader(path, "occurrences", SCHEMAS["occurrences"].names)
    parts = reader.partitions()
    assert len(parts) == 3 and [r for p in parts for r in reader.read(p)] == ROWS["occurrences"]


def test_sparse_rowids_make_few_parts(tmp_path, monkeypatch):
    rows = ROWS | {"symbols": [(1 << (9 * i), f"s{i}", None, None, None) for i in range(7)]}
    path = tmp_path / "index.db"
    conn = sqlite3.connect(path)
    conn.execute("create table symbols (id integer primary key, symbol_id, kind, documentation, file_id)")
    conn.executemany("insert into symbols values (?, ?, ?, ?, ?)", rows["symbols"])
    conn.commit()
    conn.close()
    for span, parts in ((3, 3), (1, 7), (100, 1)):
        monkeypatch.setattr(sqlite, "SPAN", span)
        reader = sqlite.TableReader(str(path), "symbols", SCHEMAS["symbols"].names)
        found = reader.partitions()
        assert len(found) == parts and [r for p in found for r in reader.read(p)] == rows["symbols"]


def test_lookups_push_their_filters_to_the_stored_index(spark, sample, tmp_path, capsys):
    from lodestar.operators import definition, references

    sample.write(str(tmp_path / "ix"))
    again = CodeIndex.from_parquet(spark, str(tmp_path / "ix"))
    for df in (references.page(again, ROWS["symbols"][0][1]), definition.by_id(again, ROWS["symbols"][0][1])):
        df.explain("formatted")
        assert re.search(r"PushedFilters: \[.*EqualTo\(symbol_id,swift MyModule MyClass#\)", capsys.readouterr().out)


def test_a_catalogue_and_a_session_folder(spark, sample, tmp_path):
    from lodestar import storage

    sample.write(str(tmp_path / "ix"))
    assert storage.catalogue(spark, str(tmp_path / "ix")) == sorted(SCHEMAS) and storage.catalogue(spark, str(tmp_path / "none")) == []
    storage.delete(spark, str(tmp_path / "ix" / "symbols.parquet"))
    with pytest.raises(SchemaError, match="missing tables: symbols$"):
        CodeIndex.from_parquet(spark, str(tmp_path / "ix"))
    assert storage.session_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_cluster_has_to_name_its_shared_folder():
    from types import SimpleNamespace

    from lodestar import storage

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(session)


def test_files_are_read_only_and_checked(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sqlite.connect(str(tmp_path / "none.db"))
    path = write_sqlite(tmp_path / "index.db")
    conn = sqlite.connect(path)
    with pytest.raises(sqlite3.OperationalError):
        conn.execute("delete from symbols")
    conn.close()
    with pytest.raises(SchemaError, match="occurrences, symbols"):
        CodeIndex.from_sqlite(spark, write_sqlite(tmp_path / "part.db", skip=("symbols", "occurrences")))


def test_parquet_round_trip(spark, sample, tmp_path):
    sample.write(str(tmp_path / "ix"))
    again = CodeIndex.from_parquet(spark, str(tmp_path / "ix"))
    assert again.occurrences.count() == 6
    with pytest.raises(SchemaError):
        CodeIndex.from_parquet(spark, str(tmp_path))


def test_settings(tmp_path):
    file = tmp_path / "config.yaml"
    file.write_text("# a comment\nrepo_path: .\ndb_path: 'some.db' # here\n")
    assert config.load(file).db_path == Path("some.db").resolve()
    assert config.load(file, db_path="~/x.db").db_path == Path("~/x.db").expanduser().resolve()
    assert config.load(tmp_path / "none.yaml").db_path == Path("index.db").resolve()


def test_roles():
    assert (Role.DEFINITION, Role.IMPORT, Role.WRITE_ACCESS, Role.READ_ACCESS, Role.REFERENCE, Role.GENERATED, Role.TEST) == (1, 2, 4, 8, 8, 16, 32)


def test_command_line(spark, tmp_path, capsys):
    path = write_sqlite(tmp_path / "index.db")
    said = lambda *a: (cli.main([*a, "--db", path], spark), capsys.readouterr().out)
    code, out = said("status")
    assert code == 0 and "test-indexer" in out and "Occurrences" in out
    assert "MockMyClass" in said("search", "MyClass", "-n", "5")[1]
    assert "No symbols found" in said("search", "zzz")[1]
    out = said("definition", "MyClass")[1]
    assert "MyClass (class)" in out and "File: Sources/MyClass.swift:10" in out and "Members: doSomething()" in out
    assert "not found" in said("definition", "zzz")[1]
    assert "Sources/Assembly.swift:15 (in register)" in said("references", "MyClass")[1]
    assert "No references" in said("references", "IMyProtocol")[1]
    assert cli.main(["status", "--db", str(tmp_path / "none.db")], spark) == 1
