"""A corpus cleaning pipeline over `documents`.

STAGES are applied in order; each reads, as Parquet, what the one before has written and keeps its columns:

1. language: documents without an identifiable language go (no letter, or no labelled text to learn from);
2. lines: chunks of lines that already stand in an earlier place are cut out of the texts;
3. near duplicates: of each group of near duplicates the document with the least id stays;
4. benchmark: documents that hold a window of a benchmark item go;
5. pieces: the texts are encoded; the last stage returns ids and counts, and whether decoding gives the text back.

A row without doc_id takes part in no group of near duplicates and stays. A document all of whose lines are cut out has
an empty text and stays, too. Extra columns pass through all stages but the last, whatever their names. An empty table
gives an empty result. The last stage's round_trip is false for a text that holds the model's white space mark itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard_join, language_id, line_dedup, sentence_pieces
from lodestar.llm.common import LAST_ID, cut, fresh, table, watched
from lodestar.storage import delete


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prefix = "_"
    while fresh(docs, *(own := [prefix + c for c in language_id.ADDED])) != tuple(own):
        prefix += "_"
    found = language_id.identify(docs, language_id.sample(docs), prefix=prefix)
    return found.where(F.col(prefix + "lang_pred") != language_id.UND).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The operator's own columns get names of their own first, so that none of docs' can clash with them.
    own = docs.select(*(F.col(c).alias(f"__{c}") for c in docs.columns))
    found = line_dedup.dedup(own, id_col="__doc_id", text_col="__text")
    kept = {"text": F.col("kept")} | ({"n_chars": F.when(F.col("n_removed_lines") > 0, F.length("kept")).otherwise(F.col("__n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return found.select(*(kept.get(c, F.col(f"__{c}")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join.classes(docs)
    d, th = fresh(docs, "d", "th")
    first = found.where(F.col("d") == F.col("component_id")).select(F.col("d").alias(d), F.col("th").alias(th))
    rows = docs.withColumns({d: F.col("doc_id").cast("long"), th: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    kept = rows.where(F.col(d).isNotNull()).join(first, [d, th], "left_semi")
    return kept.unionByName(rows.where(F.col(d).isNull())).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"))[1].select("d", "th").distinct()
    d, th = fresh(docs, "d", "th")
    rows = docs.withColumns({d: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), th: F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    return rows.join(hit.select(F.col("d").alias(d), F.col("th").alias(th)), [d, th], "left_anti").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sentence_pieces.encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), public_tokenizers.path("piece_bpe_32k.model"), memo=150_000)
    return found.select("doc_id", F.col("ids"), F.size("ids").cast("long").alias("n_ids"), F.col("exact").alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pieces", pieces)]

#: The suffix automata's phrases, and the merges of the piece model, are not SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with watched() as paths:
            docs = cut(stage(spark, docs, sf_dir))
        # The last table written is the stage's result; nothing reads those of its steps, or the one before, again.
        for path in (*done, *paths[:-1]):
            delete(spark, path)
        done = paths[-1:]
    return docs
