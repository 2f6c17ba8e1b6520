"""Small tables for the corpus operators: every defined case, and extra columns whose names clash with internal ones."""

from __future__ import annotations

import random

CLASH = ("d", "th", "c", "n", "h", "lang_pred", "score", "ids", "kept", "runs", "at", "spans", "component_id", "out", "lines", "key", "lead", "fp", "w", "a", "b", "d_", "th_", "__d", "__th", "__lang_pred", "_score", "_bits", "__row", "__lines", "__text", "doc", "runs_")


def documents(spark, texts, lang=None, clash=True):
    """texts: (doc_id, text) pairs."""
    rows = [(i, t, lang, "s", len(t or "")) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({x: F.lit("x") for x in CLASH})
    return df


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def corpus(seed=0):
    """Texts with exact and edited copies, shared passages, long and empty texts, nulls, repeated rows."""
    rng = random.Random(seed)
    shared = words(rng, 70)
    base = words(rng, 120)
    edited = base.split()
    edited[5] = "changed"
    out = [base, base, " ".join(edited), f"{words(rng, 40)} {shared} {words(rng, 30)}", f"{shared}\n{words(rng, 60)}", shared, "", None, "one", "one two three", "One two three", "one two three four five", "  \t\n ", "é à ü " * 30, "aaaa " * 80, "x" * 300, "x" * 400, words(rng, 3000), words(rng, 200) + "\n" + base]
    texts = [(i + 1, t) for i, t in enumerate(out)]
    return [*texts, texts[0], (None, base), (None, None), (3, "a text with an id that is there already")]


def thue_morse(n):
    """n bits whose hash by powers of an odd base, modulo a power of two, equals that of their complement."""
    return [bin(i).count("1") % 2 for i in range(n)]


def answer(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=repr)
