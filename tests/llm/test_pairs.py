"""Jaccard and embedding joins against all pairs, and components."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import common, cover_tree, jaccard_join
from lodestar.llm.common import components
from tests.llm.frames import answer, corpus, documents, thue_morse, words


def closed(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("seed", "at_once"), [(0, 40), (1, 1 << 20)])
def test_components(spark, monkeypatch, seed, at_once):
    monkeypatch.setattr(common, "EDGES", at_once)
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(500, i) for i in range(501, 560)] + [(i, i + 1) for i in range(1000, 1060)]
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long").repartition(9)).collect()))
    assert got == closed(nodes, [e for e in edges if e[0] != e[1]])


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_sets(texts, size=5):
    out = []
    for _, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
        out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def plain_join(texts, percent=75):
    sets = plain_sets(texts)
    links = []
    for x in range(len(texts)):
        for y in range(x):
            if texts[x][0] is not None and texts[y][0] is not None and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= percent * (len(sets[x]) + len(sets[y]) - n):
                    links.append((texts[x][0], texts[y][0]))
    comp = closed({i for i, _ in texts if i is not None}, links)
    return sorted(((i, None if i is None else len(s), comp.get(i)) for (i, _), s in zip(texts, sets)), key=repr)


def near_copies(seed):
    rng = random.Random(seed)
    texts, n = [], 0
    for length in (5, 6, 8, 12, 20, 45, 90, 200, 600):
        base = words(rng, length, 5000).split()
        for _ in range(7):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + length // 12)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([["new"], [], ["two", "more"]])
            if rng.random() < 0.3:
                w += words(rng, length // 5).split()
            n += 1
            texts.append((n * 3 % 1000, " ".join(w)))
    return texts


@pytest.mark.parametrize("texts", [corpus(5), near_copies(1), near_copies(2)])
def test_jaccard_join(spark, texts):
    got = jaccard_join.with_components(documents(spark, texts)).select("doc_id", "n_shingles", "component_id")
    assert answer(got) == plain_join(texts)


def test_keys_of_very_many_documents(spark, monkeypatch):
    """With a low limit all keys are told by pairs of blocks; a passage that all documents share links none."""
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    rng = random.Random(7)
    passage = words(rng, 30)
    texts = [*near_copies(3), *((2000 + i, f"{words(rng, 40, 9000)} {passage} {words(rng, 40, 9000)}") for i in range(25))]
    got = jaccard_join.with_components(documents(spark, texts).repartition(5)).select("doc_id", "n_shingles", "component_id")
    assert answer(got) == plain_join(texts)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """Copies edited to about the threshold: many pairs link, many nearly do. Shards tell forests, arenas find the rest."""
    monkeypatch.setattr(jaccard_join, "ARENA", 40)
    rng = random.Random(11)
    base = words(rng, 60, 5000).split()
    texts = []
    for i in range(900):
        w = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 2, 2, 3, 3, 4])):
            w[k] = f"e{rng.randrange(9999)}"
        texts.append((i, " ".join(w)))
    docs = documents(spark, texts, clash=False).repartition(6)
    told = []
    whole = jaccard_join._candidates
    monkeypatch.setattr(jaccard_join, "_candidates", lambda *a: told.append(whole(*a)) or told[-1])
    got = jaccard_join.with_components(docs).select("doc_id", "n_shingles", "component_id")
    assert answer(got) == plain_join(texts)
    assert told[0].count() < 4 * len(texts)  # of some 100,000 pairs


@pytest.mark.parametrize("seed", range(6))
def test_arenas_find_every_component(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, (3, 40), dtype=np.uint64)
    parts = []
    for _ in range(60):
        x = base[rng.integers(0, 3)].copy()
        k = rng.integers(0, 9)
        x[rng.integers(0, 40, k)] = rng.integers(0, 1 << 60, k, dtype=np.uint64)
        parts.append(np.unique(x))
    d = rng.permutation(1000)[:60].astype(np.int64)
    sets = [set(p.tolist()) for p in parts]
    links = [(int(d[i]), int(d[j])) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    known = [x for x in links if rng.random() < 0.2]
    before = closed(d.tolist(), known)
    c = np.array([before[int(x)] for x in d])
    most = np.bincount(c).argmax()
    odd = c != most
    # As in a task that has the whole arena: everyone is there, the odd ones ask.
    ask = np.flatnonzero(odd)
    order = np.concatenate([np.arange(60), ask])
    a, b = jaccard_join._arena(d[order], c[order], odd[order], np.arange(len(order)) >= 60, [parts[i] for i in order], 75)
    edges = list(zip(a.tolist(), b.tolist()))
    assert set(edges) <= {(min(x), max(x)) for x in links} and len(edges) < 60
    assert closed(d.tolist(), known + edges) == closed(d.tolist(), links)


def test_forests_of_pairs():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 80, (2, 150))
    d = rng.permutation(500)[:80]
    a, b, _ = jaccard_join.spanning(x[x != y], y[x != y], rng.integers(0, 9, int((x != y).sum())), d)
    whole, forest = (closed(range(80), list(zip(p.tolist(), q.tolist()))) for p, q in ((x, y), (a, b)))
    assert whole == forest and len(a) == 80 - len(set(whole.values()))


def test_numbered_shingles_equal_plain_sets():
    texts = [*corpus(4), *near_copies(4)]
    raw = [(t or "").encode() for _, t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    sets = plain_sets(texts)
    for size in (5, 1, 3):
        sets = plain_sets(texts, size)
        found, begin = jaccard_join.named(data, offsets, size)
        mine = [set(found[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
        assert list(map(len, mine)) == list(map(len, sets))
        assert [len(a & b) for a, b in zip(mine, mine[1:])] == [len(a & b) for a, b in zip(sets, sets[1:])]
    assert len(jaccard_join.named(np.zeros(0, np.uint8), np.zeros(1, np.int64), 5)[0]) == 0


def test_words_that_hashes_by_powers_confuse(spark):
    bits = thue_morse(1024)
    texts = [(i, "".join("ab"[b ^ x] for b in bits)) for i, x in ((1, 0), (2, 1), (3, 0))]
    assert answer(jaccard_join.with_components(documents(spark, texts)).select("doc_id", "n_shingles", "component_id")) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_extra_columns_keep_their_values(spark):
    docs = documents(spark, [(1, "a b"), (2, "a b")])
    got = jaccard_join.with_components(docs)
    assert set(got.columns) == {*docs.columns, "n_shingles", "component_id"}
    assert {r[c] for r in got.collect() for c in ("d", "th", "__th", "d_", "c")} == {"x"}


def test_documents_with_too_few_words_share_a_key():
    sets = np.sort(np.array([1 << 40, 2 << 40, 3 << 40], np.uint64))  # all in one word
    sketch, key, few = jaccard_join.keys(sets, np.array([0, 3]), 75)
    assert few.any() and len(key) == len(sketch)


def test_documents_without_a_common_shingle_share_no_key():
    """Words of one or two bits were met by chance, and by more pairs than there are documents."""
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.integers(0, 2**64, 100, dtype=np.uint64)) for _ in range(300)]
    sketch, key, few = jaccard_join.keys(np.concatenate(sets), np.arange(301) * 100, 75)
    pairs = np.unique(np.stack([key[~few], (sketch[~few] // 2).astype(np.uint64)]), axis=1)
    assert len(np.unique(pairs[0])) == pairs.shape[1] > 300 * 30
    # With all but one shingle in common, all words but two agree.
    other = np.sort(np.append(sets[0][1:], rng.integers(0, 2**64, dtype=np.uint64)))
    sketch, key, few = jaccard_join.keys(np.concatenate([sets[0], other]), np.array([0, 100, 200]), 75)
    one, two = (set(key[(sketch == 2 * i) & ~few].tolist()) for i in (0, 1))
    assert len(one - two) <= 2 and len(two - one) <= 2 < len(one & two)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 2**63, 40, dtype=np.uint64)]))
        both = np.concatenate([a, b])
        s = jaccard_join.bits(both, np.array([0, len(a), len(both)]), np.array([0, 1]), 8)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= len(np.setxor1d(a, b))


def test_jaccard_of_nothing(spark):
    assert jaccard_join.with_components(documents(spark, [])).count() == 0
    got = jaccard_join.with_components(documents(spark, [(1, None), (2, ""), (None, "a b")])).select("doc_id", "n_shingles", "component_id")
    assert answer(got) == [(1, 0, 1), (2, 0, 2), (None, None, None)]


# Embeddings


def plain_vectors(rows, cosine):
    ok = [(i, lab, np.array(v, float)) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0]
    ok = [(i, lab, v / np.abs(v).max()) for i, lab, v in ok]
    ok = [(i, lab, v / np.linalg.norm(v)) for i, lab, v in ok]
    links = [(p[0], q[0]) for x, p in enumerate(ok) for q in ok[:x] if p[1] == q[1] and len(p[2]) == len(q[2]) and p[2] @ q[2] >= cosine]
    comp = closed({i for i, _, _ in rows if i is not None}, links)
    n = {i: sum((a == i) + (b == i) for a, b in links) for i, _, _ in rows}
    return sorted(((i, None if i is None else n[i], comp.get(i), None if i is None else comp[i] == i) for i, _, _ in rows), key=repr)


def vectors(seed, n=150, dim=6, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dim))
    return [(int(i), [float(v) for v in centers[k] + rng.normal(size=dim) * spread * rng.random()], int(k % 3)) for i, k in enumerate(rng.integers(0, 9, n))]


SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({x: F.lit("x") for x in ("id", "x", "n", "cell", "i", "j", "own", "blocks", "kept", "component_id")})


@pytest.mark.parametrize(("seed", "how"), [(0, {}), (1, {"block": 11}), (2, {"block": 7, "sample": 20}), (3, {"cosine": 0.9, "most": 5})])
def test_cover_tree(spark, seed, how):
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in vectors(seed)]
    rows += [(900, rows[0][1], rows[0][2]), (901, [2 * x for x in rows[0][1]], rows[0][2]), (902, rows[0][1], None), (903, None, 1), (904, [], 1), (905, [0.0] * 6, 1), (906, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (907, [float("nan")] * 6, 1), (908, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 1), (None, rows[0][1], 1), (909, [1.0, 1.0], 1), (910, [1.0, 1.0], 1), (911, [1e-38] * 6, 2), (912, [3e38] * 6, 2)]
    got = cover_tree.near_duplicates(frame(spark, rows), **how)
    assert answer(got) == plain_vectors(rows, how.get("cosine", 0.98))


def test_a_common_vector(spark):
    """A third of all rows has one vector; it is compared once, and counted for all."""
    rng = np.random.default_rng(9)
    common = rng.normal(size=6)
    rows = [(i, [float(np.float32(v)) for v in (common if i % 3 == 0 else common + rng.normal(size=6) * 0.2)], i % 2) for i in range(240)]
    rows += [(6, rows[6][1], 0), (6, rows[6][1], 0)]
    assert answer(cover_tree.near_duplicates(frame(spark, rows), block=50)) == plain_vectors(rows, 0.98)


def test_no_vectors(spark):
    assert cover_tree.near_duplicates(frame(spark, [])).count() == 0
    assert answer(cover_tree.near_duplicates(frame(spark, [(1, None, None)]))) == [(1, 0, 1, True)]


def test_traversal_links_whole_nodes():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 8))[rng.integers(0, 3, 400)] + rng.normal(size=(400, 8)) * 1e-4
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree, counts, told = cover_tree.Tree(x), np.zeros(400, np.int64), []
    cover_tree.dual(tree, tree, 0.2, 0.98, counts, counts, lambda a, b: told.append(len(a)), np.ones(400, np.int64), np.ones(400, np.int64))
    assert (counts == (x @ x.T >= 0.98).sum(axis=1) - 1).all() and sum(told) < 4000  # not all of some 27,000 pairs
