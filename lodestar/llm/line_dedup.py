"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk where it is divisible by `divisor`, so chunk ends depend on
nearby lines alone and survive lines put in or taken out elsewhere. A chunk of at least `least` lines whose bytes occur in
more than one place is removed everywhere but at its first place, by (doc_id, place in the text). Hashes only choose
candidates; what is removed is grouped by its bytes. Only DataFrame functions are used.

Defined cases: null text is empty (one empty line); rows that repeat id and text are one document for this and all keep
or lose the same lines; null ids come after all others; lines end at \\n only, so a \\r is part of its line; an empty table
gives an empty result; a text may be of any length (its lines are one array, so memory grows with the longest); other
columns pass through, whatever their names, but for those that are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import LAST_ID, cut, table
from lodestar.llm.native import keyed, let, small

ADDED = ("kept", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
WINDOW = 2
FACTOR = 31


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def ends(lines: Column, divisor: int) -> Column:
    """1-based numbers of the lines that end a chunk."""

    def of(hs: Column) -> Column:
        roll = lambda h, i: h + sum((FACTOR**j * F.coalesce(F.get(hs, i - j), F.lit(0)) for j in range(1, WINDOW)), F.lit(0))
        at = F.transform(hs, lambda h, i: F.when((F.pmod(roll(h, i), F.lit(divisor)) == 0) | (i == F.size(hs) - 1), i + 1))
        return F.filter(at, lambda i: i.isNotNull())

    return let(F.transform(lines, line_hash), of)


def chunks(lines: Column, divisor: int) -> Column:
    """array<struct<at, n>>: first line (1-based) and number of lines of each chunk."""
    return let(ends(lines, divisor), lambda es: F.transform(es, lambda e, j: F.struct((F.coalesce(F.get(es, j - 1), F.lit(0)) + 1).alias("at"), (e - F.coalesce(F.get(es, j - 1), F.lit(0))).alias("n"))))


def dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, least: int = 2) -> DataFrame:
    """df's rows with kept (the text that stays), n_lines, n_chunks, n_removed_chunks and n_removed_lines added (in place of columns so named)."""
    lines = F.split("text", "\n", -1)
    rows = keyed(df, id_col, text_col)
    cs = rows.select("d", "th", "text", lines.alias("lines")).select("d", "th", "lines", F.explode(F.filter(chunks(F.col("lines"), divisor), lambda c: c["n"] >= least)).alias("c"))
    cs = cs.select("d", "th", F.col("c.at").alias("at"), F.col("c.n").alias("n"), F.array_join(F.slice("lines", F.col("c.at"), F.col("c.n")), "\n").alias("bytes"))
    place = F.struct("d", "th", "at")
    twice = cs.select(F.xxhash64("bytes").alias("h"), place.alias("p")).groupBy("h").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("h")
    again = cut(cs.withColumn("h", F.xxhash64("bytes")).join(small(cut(twice)), "h", "left_semi").drop("h"))
    first = small(cut(again.groupBy("bytes").agg(F.min(place).alias("first"))), 20_000)
    out = again.join(first, "bytes").where(place != F.col("first")).groupBy("d", "th").agg(F.collect_set(F.struct("at", "n")).alias("out"))

    extra = [c for c in df.columns if c in (id_col, text_col) or c not in ADDED]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("__d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__th"), F.struct(*(F.col(c) for c in extra)).alias("__row"))
    docs = docs.join(out.select(F.col("d").alias("__d"), F.col("th").alias("__th"), "out"), ["__d", "__th"], "left")
    own = F.split(F.coalesce(F.col(f"__row.{text_col}"), F.lit("")), "\n", -1)
    gone = lambda i: F.exists("out", lambda c: (c["at"] <= i + 1) & (i + 1 < c["at"] + c["n"]))
    kept = F.when(F.col("out").isNull(), F.col(f"__row.{text_col}")).otherwise(F.array_join(F.filter(own, lambda x, i: ~gone(i)), "\n"))
    zero = F.lit(0).cast("long")
    return docs.select("__row", own.alias("__lines"), kept.alias("kept"), F.when(F.col("out").isNull(), zero).otherwise(F.size("out").cast("long")).alias("n_removed_chunks"), F.coalesce(F.aggregate("out", zero, lambda a, c: a + c["n"]), zero).alias("n_removed_lines")).select(
        "__row.*", "kept", F.size("__lines").cast("long").alias("n_lines"), F.size(ends(F.col("__lines"), divisor)).cast("long").alias("n_chunks"), "n_removed_chunks", "n_removed_lines"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with l as (select doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::bigint h from (select doc_id, generate_subscripts(ls, 1) i, unnest(ls) line from (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents))),
e as (select *, ((h + 31 * coalesce(lag(h) over w, 0)) % 3 = 0 or lead(h) over w is null)::int is_end from l window w as (partition by doc_id order by i)),
c as (select *, coalesce(sum(is_end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) k from e),
ch as (select doc_id, k, count(*) n, string_agg(line, chr(10) order by i) body from c group by doc_id, k),
r as (select doc_id, k, n, n >= 2 and row_number() over (partition by body order by doc_id, k) > 1 gone from ch)
select doc_id, sum(n)::bigint n_lines, count(*)::bigint n_chunks, count(*) filter (where gone)::bigint n_removed_chunks, coalesce(sum(n) filter (where gone), 0)::bigint n_removed_lines, kept_sha256
from r join (select doc_id, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) kept_sha256 from c join r using (doc_id, k) group by doc_id) using (doc_id) group by doc_id, kept_sha256
"""
