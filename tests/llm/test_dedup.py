"""Suffix-array, substring and line dedup against plain versions."""

import hashlib
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import hashes, line_dedup, repeats, substring_dedup, suffix_dedup
from lodestar.llm.common import LAST_ID
from lodestar.llm.suffix_array import equal_windows, suffix_order
from tests.llm.frames import answer, corpus, documents, thue_morse

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(rows, units, length):
    """For each row, which of its units lie in a window that also starts in a smaller id."""
    least = defaultdict(lambda: LAST_ID)
    for d, u in zip(rows, units, strict=True):
        for i in range(len(u) - length + 1):
            w = tuple(u[i : i + length])
            least[w] = min(least[w], d)
    out = []
    for d, u in zip(rows, units, strict=True):
        gone = [False] * len(u)
        for i in range(len(u) - length + 1):
            if least[tuple(u[i : i + length])] < d:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.mark.parametrize("length", [50, 12])
def test_suffix_dedup(spark, length):
    texts = corpus()
    raw = [(t or "").encode() for _, t in texts]
    gone = covered([LAST_ID if i is None else i for i, _ in texts], raw, length)
    expected = []
    for (i, _), b, g in zip(texts, raw, gone, strict=True):
        kept = bytes(x for x, y in zip(b, g, strict=True) if not y)
        expected.append((i, len(b), sum(g), sum(y and not x for x, y in zip([False, *g], g)), sha(kept)))
    assert answer(suffix_dedup.dedup(documents(spark, texts), length=length).drop("spans")) == sorted(expected, key=repr)


@pytest.mark.parametrize("length", [50, 7, 1])
def test_substring_dedup(spark, length):
    texts = corpus(1)
    units = [WORD.findall((t or "").encode()) for _, t in texts]
    gone = covered([LAST_ID if i is None else i for i, _ in texts], units, length)
    expected = [(i, len(u), sum(g), b" ".join(x for x, y in zip(u, g, strict=True) if not y).decode()) for (i, _), u, g in zip(texts, units, gone, strict=True)]
    assert answer(substring_dedup.dedup(documents(spark, texts), length=length)) == sorted(expected, key=repr)


def test_a_hot_passage_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PART", 200)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [(i, f"own{i} " * 3 + passage + f" tail{i}" * 4) for i in range(60)]
    units = [WORD.findall(t.encode()) for _, t in texts]
    gone = covered([i for i, _ in texts], units, 50)
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup(documents(spark, texts).repartition(7)).collect()}
    assert got == {i: sum(g) for (i, _), g in zip(texts, gone, strict=True)}
    gone = covered([i for i, _ in texts], [t.encode() for _, t in texts], 50)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup(documents(spark, texts).repartition(7)).collect()}
    assert got == {i: sum(g) for (i, _), g in zip(texts, gone, strict=True)}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_order(t):
    assert suffix_order(np.array(t, np.int64)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=8, max_size=80), st.integers(1, 8))
def test_equal_windows(t, length):
    starts = np.arange(len(t) - length + 1)
    cls = equal_windows(np.array(t), starts, length).tolist()
    seen = {}
    for i in starts:
        assert seen.setdefault(tuple(t[i : i + length]), cls[i]) == cls[i]
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\x0b\né", max_size=12), max_size=5))
def test_words_of_a_batch(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, h, at = hashes.words(data, offsets, lower=True)
    got = [[bytes(data[a:b]) for a, b in zip(start[i:j], end[i:j])] for i, j in zip(at[:-1], at[1:])]
    assert got == [WORD.findall(r) for r in raw]
    flat = [w.lower() for r in raw for w in WORD.findall(r)]
    assert len({(a, int(b)) for a, b in zip(flat, h)}) == len(set(flat))


def test_words_that_hashes_by_powers_confuse(spark):
    """49 equal words and a 50th of 1,024 bytes that differs everywhere; and whole texts like that."""
    bits = thue_morse(1024)
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    head = " ".join(f"w{i}" for i in range(49))
    docs = documents(spark, [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head}\t{one}")])
    assert answer(substring_dedup.dedup(docs).select("doc_id", "n_removed")) == [(1, 0), (2, 0), (3, 50)]
    got = suffix_dedup.dedup(documents(spark, [(1, one), (2, two)])).collect()
    gone = covered([1, 2], [one.encode(), two.encode()], 50)
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i + 1: sum(g) for i, g in enumerate(gone)}


def test_spans_of_one_hash_are_told_apart_by_their_bytes():
    data = np.frombuffer(b"abcabdabc" + b"x" * 40 + b"x" * 39 + b"y", np.uint8)
    start, end = np.array([0, 3, 6, 9, 49, 0]), np.array([3, 6, 9, 49, 89, 0])
    number, n = hashes.exact(data, start, end, np.zeros(6, np.uint64))
    assert n == 5 and number[0] == number[2] and len(set(number.tolist())) == 5
    assert hashes.same_spans(data, start, end, np.array([2, 0, 0, 4, 3, 5])).tolist() == [True, False, True, False, False, True]
    long = np.frombuffer(b"a" * 3000 + b"a" * 2999 + b"b", np.uint8)
    one, two = hashes.spans(long, np.array([0, 3000]), np.array([3000, 6000])).tolist()
    assert one != two and hashes.spans(long, np.array([0]), np.array([3000]))[0] == one


def test_levels_double():
    assert substring_dedup.levels(50) == (13, 25, 50)
    for n in range(1, 400):
        levels = substring_dedup.levels(n)
        assert levels[-1] == n and all(a <= b <= 2 * a for a, b in zip(levels, levels[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "c" * 20]), min_size=5, max_size=30), min_size=1, max_size=6), st.integers(1, 5))
def test_windows_are_named_by_doubling(contents, length):
    bodies = [" ".join(c).encode() for c in contents]
    windows = np.array([len(c) - length + 1 for c in contents])
    cls = substring_dedup.by_doubling(length)(np.frombuffer(b"".join(bodies), np.uint8), np.array([len(b) for b in bodies]), windows).tolist()
    flat = [tuple(c[i : i + length]) for c in contents for i in range(len(c) - length + 1)]
    assert len(cls) == len(flat) and len(set(zip(cls, flat))) == len(set(cls)) == len(set(flat))


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80), st.integers(1, 20))
def test_grams_of_bytes(data, n):
    g = repeats.Bytes(np.frombuffer(data, np.uint8), np.array([0, len(data)])).grams(n)
    flat = [data[i : i + n] for i in range(len(data) - n + 1)]
    assert len(g) == len(flat) and len(set(zip(g.tolist(), flat))) == len(set(g.tolist())) == len(set(flat))


def plain_lines(texts, divisor=3, least=2):
    first, cut = {}, []
    for n, (i, t) in enumerate(texts):
        lines = (t or "").split("\n")
        hs = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        ends = [k for k in range(len(lines)) if k == len(lines) - 1 or (hs[k] + 31 * (hs[k - 1] if k else 0)) % divisor == 0]
        chunks = [lines[a + 1 : b + 1] for a, b in zip([-1, *ends], ends)]
        cut.append(chunks)
        for k, c in enumerate(chunks):
            place = (LAST_ID if i is None else i, k, t)
            if len(c) >= least:
                key = "\n".join(c)
                first[key] = min(first.get(key, place), place, key=lambda p: p[:2])
    out = []
    for (i, t), chunks in zip(texts, cut, strict=True):
        keep = [c for k, c in enumerate(chunks) if len(c) < least or first["\n".join(c)] == (LAST_ID if i is None else i, k, t)]
        out.append((i, sum(map(len, chunks)), len(chunks), len(chunks) - len(keep), "\n".join(x for c in keep for x in c)))
    return out


def test_line_dedup(spark):
    block = "\n".join(f"line {i}" for i in range(12))
    texts = [(1, f"a\n{block}\nz"), (2, f"b\nc\n{block}\ny\n"), (3, block), (4, ""), (5, None), (6, "\n\n\n"), (7, "\n\n\n"), (8, f"{block}\n{block}"), (9, "single"), (10, "single"), (1, f"a\n{block}\nz"), (None, block), (11, "q\r\n" * 6), (12, "q\r\n" * 6)]
    got = line_dedup.dedup(documents(spark, texts))
    assert {"d", "th", "out", "lines"} <= set(got.columns)
    assert answer(got.select("doc_id", "n_lines", "n_chunks", "n_removed_chunks")) == sorted((x[:4] for x in plain_lines(texts)), key=repr)
    bare = line_dedup.dedup(documents(spark, texts, clash=False))
    assert answer(bare.selectExpr("doc_id", "n_lines", "n_chunks", "n_removed_chunks", "coalesce(kept, '')")) == sorted(plain_lines(texts), key=repr)


def test_shift_resistance(spark):
    block = [f"line {i}" for i in range(40)]
    texts = [(1, "\n".join(block)), (2, "\n".join(["new", "newer", *block]))]
    got = {r["doc_id"]: r["n_removed_lines"] for r in line_dedup.dedup(documents(spark, texts)).collect()}
    assert got[1] == 0 and got[2] >= 25


def shuffled(spark, df):
    """Bytes that the stages of df write to shuffles."""
    store, gateway = spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_more_shards_send_no_more_of_each_text(spark, monkeypatch):
    """Ids of texts went to each shard that has one of their strings: of many shards, one for nearly each string."""
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdefghij ", k=200)) for _ in range(40)]
    texts = documents(spark, [(i, "".join(rng.choice(shared) + "".join(rng.choices("klmnopqrst ", k=300)) for _ in range(6))) for i in range(300)], clash=False).repartition(2).localCheckpoint()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    sent, answers = [], []
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        for shards in (2, 200):
            # Only what meets is dealt to more shards, the texts aren't.
            monkeypatch.setattr(repeats, "tasks", lambda df: shards if sys._getframe(1).f_code.co_name in ("live", "repeated") else 2)
            answers.append(answer(suffix_dedup.dedup(texts)))
            sent.append(shuffled(spark, suffix_dedup.dedup(texts)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert answers[0] == answers[1]
    assert 0 < 4 * sent[1] < 5 * sent[0], sent


def test_numbers_that_are_dealt_evenly(spark):
    for n in (1, 2, 7, 51, 600):
        k = repeats.even(n).tolist()
        parts = spark.createDataFrame([(x,) for x in k], "k int").selectExpr(f"pmod(hash(k), {n}) p").distinct().count()
        assert parts == n == len(set(k))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5) | st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 12))
def test_least_hash_is_the_same_in_small_and_large_batches(values, span):
    values = np.array(values, np.uint64) << np.uint64(1)
    high = [v >> repeats.PLACE for v in values.tolist()]
    plain = [min(range(i, i + span), key=lambda j: (high[j], j)) for i in range(len(high) - span + 1)]
    assert repeats.shown(values, span).tolist() == plain
    assert repeats.sliding_argmin(values >> np.uint64(repeats.PLACE), span).tolist() == plain


def test_packed_numbers():
    for values in ([], [0], [3, 3, 4, 2**32 - 1], list(range(0, 10**6, 997))):
        v = np.array(values, np.int64)
        assert repeats.unplaned(repeats.planes(v)).tolist() == values == repeats.unstepped(repeats.steps(v)).tolist()


@pytest.mark.parametrize("run", [suffix_dedup.dedup, substring_dedup.dedup, line_dedup.dedup])
def test_empty_table(spark, run):
    assert run(documents(spark, [])).count() == 0
