"""Benchmark decontamination by winnowing.

A window is 10 consecutive words of a benchmark item (all its words, if it has fewer). Of every window, the k-gram of
words with the least hash is a fingerprint, so a document that holds the window has that fingerprint, too: k = 5 (or the
window's length, if less) and every 10 words in a row show at least one. Fingerprints of documents and of the benchmark
are joined; around each shared one, the windows it may belong to are cut out of the document and joined with the
benchmark's windows by their words. Only DataFrame functions are used.

Words: A-Z in lower case, then runs of characters other than ASCII non-alphanumerics.

Defined cases: a null text has no words, a null item no windows; an item may occur twice and counts under its id once; a
null item_id is left out of the id list but its words are hit; repeated documents give a row each; null ids stay null; an
empty table gives an empty result, an empty benchmark hits nothing; texts may be of any length (a text is one row of
arrays, so memory grows with the longest); other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import cut, table
from lodestar.llm.native import LOWER, UPPER, keyed, let, small

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GRAM = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAK), "")


def grams(ws: Column, length: int) -> Column:
    """Hashes of the k-grams for windows of `length` words, by place. ws: word hashes."""
    k = min(GRAM, length)
    return F.slice(F.transform(ws, lambda w, i: F.xxhash64(F.lit(length), w, *(F.get(ws, i + j) for j in range(1, k)))), F.lit(1), F.greatest(F.size(ws) - (k - 1), F.lit(0)))


def prints(hashes: Column, length: int) -> Column:
    """The distinct fingerprints: the least hash of each window."""
    span = length - min(GRAM, length) + 1
    if span == 1:
        return F.array_distinct(hashes)
    least = let(hashes, lambda g: F.transform(g, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, span)))))
    return F.array_distinct(least)


def hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def windows(ws: Column, length: int, starts: Column) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("s"), F.lit(length).alias("len"), F.array_join(F.slice(ws, s + 1, length), " ").alias("win")))


def _count(ws: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(ws, F.lit(0)))


def hits(docs: DataFrame, items: DataFrame, *, length: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, hits): (d, th, doc_id, n_words) of every row, and (d, th, s, len, item_id) of every window found."""
    spark = docs.sparkSession
    bench = cut(items.select(F.col(item_col).cast("long").alias("item_id"), words(F.coalesce(F.col(item_text), F.lit(""))).alias("ws"), hashed(words(F.coalesce(F.col(item_text), F.lit("")))).alias("hs")).where(F.size("ws") > 0))
    lengths = sorted(r[0] for r in bench.select(F.least(F.size("ws"), F.lit(length)).alias("n")).distinct().collect())
    rows = keyed(docs, id_col, text_col)
    ws = hashed(words(F.col("text")))
    if not lengths:
        none = spark.createDataFrame([], "d long, th long, s int, len int, item_id long")
        return rows.select("d", "th", "doc_id", F.size(ws).cast("long").alias("n_words")), none

    of = lambda n: bench.where(F.least(F.size("ws"), F.lit(length)) == n)
    every = lambda hs: F.flatten(F.array(*(prints(grams(hs, n), n) for n in lengths)))
    # A row for each fingerprint, and one without for the document itself, under a key of its own.
    shown = rows.select("d", "th", "doc_id", ws.alias("hs")).select("d", "th", "doc_id", F.size("hs").cast("long").alias("n_words"), F.explode(F.array_append(every(F.col("hs")), F.lit(None).cast("long"))).alias("fp"))
    shown = shown.withColumn("key", F.coalesce("fp", F.xxhash64("d", "th")))
    own = None
    for n in lengths:
        part = of(n).select(F.explode(prints(grams(F.col("hs"), n), n)).alias("fp"))
        own = part if own is None else own.unionByName(part)
    own = small(cut(own.distinct().select(F.col("fp").alias("key"), F.lit(True).alias("shared"))))
    found = cut(shown.join(own, "key", "left").where("fp is null or shared").drop("key", "shared"))
    documents = found.where("fp is null").select("d", "th", "doc_id", "n_words")
    shared = small(cut(found.where("fp is not null").groupBy("d", "th").agg(F.collect_set("fp").alias("fps"))), 20_000)

    def around(n: int, ws: str, hs: str) -> Column:
        """Windows of n words around each shared k-gram."""
        span = n - min(GRAM, n) + 1
        at = F.filter(F.transform(grams(F.col(hs), n), lambda g, i: F.when(F.array_contains("fps", g), i)), lambda i: i.isNotNull())
        last = F.size(ws) - n
        starts = F.filter(F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(F.greatest(p - (span - 1), F.lit(0)), p)))), lambda s: s <= last)
        return windows(F.col(ws), n, starts)

    near = rows.select("d", "th", "text").join(shared, ["d", "th"]).select("d", "th", "fps", words(F.col("text")).alias("ws"), hashed(words(F.col("text"))).alias("hs"))
    near = near.select("d", "th", F.explode(F.flatten(F.array(*(around(n, "ws", "hs") for n in lengths)))).alias("w")).select("d", "th", "w.*")
    own = None
    for n in lengths:
        part = of(n).select("item_id", F.explode(windows(F.col("ws"), n, _count(F.size("ws") - n))).alias("w")).select("item_id", F.col("w.win").alias("win"))
        own = part if own is None else own.unionByName(part)
    return documents, near.join(small(cut(own.distinct()), 50_000), "win").select("d", "th", "s", "len", "item_id")


def contamination(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """A row for each document: d, th, doc_id, n_words, n_hit, items (array of item ids), contaminated."""
    documents, found = hits(docs, items, **how)
    by_doc = found.groupBy("d", "th").agg(F.collect_set(F.struct("s", "len")).alias("at"), F.collect_set("item_id").alias("items"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda w: F.sequence(w["s"], w["s"] + w["len"] - 1)))))
    by_doc = by_doc.select("d", "th", covered.cast("long").alias("n_hit"), "items")
    none = F.array().cast("array<long>")
    return documents.join(by_doc, ["d", "th"], "left").select("d", "th", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bl as (select item_id, ws, least(len(ws), 10) n from bw where len(ws) > 0),
wins as (select distinct item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') win from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from bl)),
lens as (select distinct n from bl),
dwin as (select doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') win from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from dw, lens)),
hit as (select doc_id, n, i, item_id from dwin join wins using (n, win)),
pos as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, n, i from hit)) group by doc_id),
its as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) ids from (select distinct doc_id, cast(item_id as varchar) item from hit) group by doc_id)
select dw.doc_id, len(dw.ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from dw left join pos using (doc_id) left join its using (doc_id)
"""
