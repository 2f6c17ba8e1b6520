"""The pipeline's stages against plain versions, and the registered queries against their SQL."""

import os

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import language_id
from lodestar.llm.queries import ORACLE_SQL, QUERIES
from lodestar.storage import session_dir
from tests.llm.frames import CLASH, corpus, documents
from tests.llm.test_dedup import plain_lines
from tests.llm.test_pairs import plain_join
from tests.llm.test_texts import plain_hits

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    items = [(1, " ".join(f"b{i}" for i in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    block = "\n".join(f"line {i} of a block" for i in range(9))
    texts = [*corpus(9), (50, "head\n" + block), (51, "other\n" + block), (52, "12 34"), (53, items[0][1] + " and more"), (54, "clean text of its own")]
    docs = documents(spark, texts, lang="en")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "lines", "near_duplicates", "benchmark", "pieces"]

    def run(name, docs):
        out = stages[name](spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    docs = docs.withColumns({"__lang_pred": F.lit("L"), "_lang_pred": F.lit("L"), "__th": F.lit("T"), "d": F.lit("D")})
    columns = docs.columns
    kept = lambda docs: {tuple(r[c] for c in ("__lang_pred", "_lang_pred", "__th", "d")) for r in docs.collect()}
    now = [(i, t) for i, t in texts if any(map(str.isalpha, t or ""))]
    docs = run("language", docs)
    assert docs.columns == columns and set(CLASH) < set(columns)
    rows = lambda: sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert rows() == sorted(now, key=repr)
    now = [(x[0], x[4]) for x in plain_lines(now)]
    docs = run("lines", docs)
    assert rows() == sorted(now, key=repr) and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    first = {(i, n) for i, n, c in plain_join(now) if i == c}
    now = [(i, t) for i, t in now if i is None or i in {x for x, _ in first}]
    docs = run("near_duplicates", docs)
    assert rows() == sorted(now, key=repr)
    dirty = {(x[0], n) for n, x in enumerate(plain_hits(now, items)) if x[4]}
    now = [x for n, x in enumerate(now) if (x[0], n) not in dirty]
    docs = run("benchmark", docs)
    assert rows() == sorted(now, key=repr) and {54} <= {i for i, _ in now} and 53 not in {i for i, _ in now}
    assert docs.columns == columns and kept(docs) == {("L", "L", "T", "D")}
    docs = run("pieces", docs)
    assert docs.count() == len(now) and docs.where("not round_trip").count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert sorted(((r["doc_id"], r["ids"]) for r in docs.collect()), key=repr) == sorted(((i, library.encode(t or "")) for i, t in now), key=repr)


def test_stages_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_contract_columns_come_first(spark):
    first = {
        "op1_language_id": "doc_id held_out lang_pred score",
        "op3_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op5_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op6_substring_dedup": "doc_id n_words n_removed kept_sha256",
        "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
        "op9_jaccard_join": "doc_id n_shingles component_id",
        "op10_cover_tree": "vec_id n_links component_id kept",
    }
    for name, columns in first.items():
        assert QUERIES[name](spark, SF).columns[: len(columns.split())] == columns.split(), name


def test_run(spark):
    before = set(os.listdir(session_dir(spark).removeprefix("file://"))) if os.path.isdir(session_dir(spark).removeprefix("file://")) else set()
    got = corpus_pipeline.run(spark, SF)
    assert len(set(os.listdir(session_dir(spark).removeprefix("file://"))) - before) == 1  # the result's table
    assert 0 < got.count() <= 200 and got.select("doc_id").distinct().count() == got.count()


def test_language_rejects_only_what_has_none(spark):
    docs = documents(spark, [(1, "words"), (2, "123")], lang="en")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]
    assert language_id.UND == "und"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    conn = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        conn.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    answer = conn.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert mine == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in answer.fetchall())
