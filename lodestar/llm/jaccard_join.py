"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct shingles (`size` words each, A-Z in lower case; with fewer words, the whole sequence
is the one shingle). Documents link when 100 * shared >= percent * all shingles of the two.

1. Equal sets (by 128 bits of hash) are one class, led by the least id; only leaders are compared.
2. Sizes fall in bands from one power of two to the next; a document whose larger partners may lie in the next band is in
   both. A band has a fixed number of 64-bit words; each shingle's hash goes to one word, whose bits are the parities of
   the hashes' bits there. Words of two documents that differ are at most as many as the shingles in which the documents
   differ: at most `allowed(n)` if they link. Words that agree stand for the same shingles (but for chance of 2^-56), so
   documents that share no shingle share no key, and keys of a few bits are not met by ever more documents.
3. So, with more than `allowed(n)` words that are not zero, one of those must agree (pigeonhole), and in any order of all
   (band, word place, word value) keys one agrees among the first allowed(n) + 1 of either document. The order is by how
   frequent a key is: a fixed-size count sketch over all documents tells it, and any error in it is harmless.
   Documents with too few such words can only miss each other, and share a key of their own.
4. Documents that share a key are candidates, if they are not known to be connected (a first round over few keys finds
   most links) and if sketches of two to four bits a shingle are no farther apart than the two sets may be. A shard tells
   not these pairs but a spanning forest of them, so it has at most as many rows as documents.
5. Documents that such forests connect are an arena. The forests' edges are verified; in an arena that still has several
   components, each document outside the largest one is compared with all others, by sketches and then by the sets, until
   its component is linked or all partners are refused. A task has a block of the arena and a block of such documents,
   and tells a spanning forest of the links it finds.
6. Links are counted by the words of the two texts, not by hashes, before they connect anything.

Keys travel packed, some of a band to a shard, with the sketch of each of the shard's documents once. A key that very many
documents have is told once for each pair of blocks of them, so no group grows beyond two blocks.

Defined cases: null or wordless text has an empty set, links with nothing and is its own component; a row without id takes
part in nothing and has a null component; rows that repeat an id are one node with all their links; an empty table gives an
empty result; texts may be of any length (a batch has one text at least, and memory grows with the longest text); equal
texts are one leader and its copies; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import hashes as H
from lodestar.llm.common import components, cut, fresh, hold, joined, map_arrow, release, squeeze, sub_batches, table, tasks, text_bytes, unsqueezed
from lodestar.llm.native import small
from lodestar.llm.repeats import Words

BATCH = 1 << 20
CELLS = 1 << 20  # of the count sketch
BLOCK = 1 << 16
HOT = 20_000  # documents of a key from which on it is told by blocks
SOME = 8  # keys of a sketch in the first round
ARENA = 512  # documents of a block in an arena
WIDEST = 64  # 64-bit words of a sketch in an arena, at most
FOUND = 1 << 18  # pairs that a shard holds before it keeps a spanning forest of them only


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, begin): the sorted distinct shingle hashes of each text."""
    _, _, words, at = H.words(data, offsets, lower=True)
    n = np.diff(at)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.uint64)
    g = H.grams(words, size)
    long = np.flatnonzero(n >= size)
    if len(long):
        owner = np.repeat(np.arange(len(n)), np.where(n >= size, count, 0))
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count[long]) - count[long], count[long])
        out[begin[owner] + step] = g[at[owner] + step]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        out[begin[few]] = H.sequences(words, at[few], at[few + 1])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begin[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[begin]


def named(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As shingles(), with numbers in place of hashes: two shingles of these texts have one number if their words are equal."""
    words = Words(H._LOWER[data], offsets)
    n = np.diff(words.offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    first = np.repeat(words.offsets[:-1] - (np.cumsum(count) - count), count) + np.arange(len(owner))
    # A shingle as its words, joined by one space.
    body, start, end = words.contents(first, first + np.minimum(size, n[owner]))
    number, total = H.exact(body, start, end, H.spans(body, start, end))
    owner, found = np.divmod(np.unique(owner * max(1, total) + number), max(1, total))
    return found, np.searchsorted(owner, np.arange(len(n) + 1))


def allowed(n: np.ndarray, percent: int) -> np.ndarray:
    """In how many shingles a set of n may differ from one that it links with."""
    return n * (100 - percent) // percent


def words_of(k: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch by which documents of band k are compared: two to four bits a shingle."""
    return np.maximum(1, 2 ** (np.asarray(k, np.int64) + 2) // 64)


def bits(sets: np.ndarray, begin: np.ndarray, which: np.ndarray, width: int) -> np.ndarray:
    """Parity sketches of the texts in `which`: a row of `width` words each; every shingle toggles one bit."""
    m = (begin[which + 1] - begin[which]).astype(np.int64)
    idx = np.repeat(begin[which] - (np.cumsum(m) - m), m) + np.arange(m.sum())
    at = (sets[idx] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    at = (at * np.uint64(64 * width)) >> np.uint64(32)
    count = np.bincount(np.repeat(np.arange(len(which)), m) * 64 * width + at.astype(np.int64), minlength=len(which) * 64 * width)
    return np.packbits((count & 1).astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little").view(np.uint64)


def keys(sets: np.ndarray, begin: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketch, key, few) of all words that are not zero of all sketches, 56 bits a key. The sketches of text i are 2 * i and,
    in the next band, 2 * i + 1; few marks the key that those with too few words share."""
    n = np.diff(begin)
    band = np.zeros(len(n), np.int64)
    band[n > 0] = np.floor(np.log2(n[n > 0])).astype(np.int64)
    texts, found, few = [], [], []
    for up in (0, 1):
        # In the next band, too, if a partner may be that large: n >= percent / 100 of its least size.
        member = (n > 0) if not up else (n > 0) & (100 * n >= percent * (2 ** (band + 1)))
        who = np.flatnonzero(member)
        if not len(who):
            continue
        m = n[who]
        idx = np.repeat(begin[who] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        h, k = sets[idx], band[who] + up
        width = np.maximum(64, (9 * 2**k) // 8).astype(np.uint64)
        doc = np.repeat(np.arange(len(who)), m)
        seg = ((h >> np.uint64(32)) * width[doc]) >> np.uint64(32)  # rises with h, and h is sorted
        new = np.ones(len(h), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        word = np.bitwise_xor.reduceat(h, first)
        doc, seg = doc[first], seg[first]
        solid = word != 0
        doc, seg, word = doc[solid], seg[solid], word[solid]
        place = (k[doc].astype(np.uint64) << np.uint64(40)) + seg
        key = H.mix(word ^ H.mix(place)) >> np.uint64(8)
        lone = np.flatnonzero(np.bincount(doc, minlength=len(who)) <= allowed(m, percent))
        texts += [2 * who[doc] + up, 2 * who[lone] + up]
        found += [key, H.mix(k[lone].astype(np.uint64) + np.uint64(1 << 50)) >> np.uint64(8)]
        few += [np.zeros(len(key), bool), np.ones(len(lone), bool)]
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(texts), np.concatenate(found), np.concatenate(few)


def _profile(rows: DataFrame, size: int, percent: int, cells: int) -> DataFrame:
    """A row (d, n, k1, k2) for each document and rows (block, salt, cells) of the count sketch for each partition."""
    schema = pa.schema([("d", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("block", pa.int32()), ("salt", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("jaccard_join", lambda: None)
        counts, salt = np.zeros(cells, np.uint32), 0
        for batch in sub_batches(batches, "text", BATCH):
            sets, begin = shingles(*text_bytes(batch.column("text")), size)
            n = np.diff(begin)
            one = np.concatenate([[np.uint64(0)], np.cumsum(H.mix(sets), dtype=np.uint64)])
            two = np.concatenate([[np.uint64(0)], np.cumsum(H.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
            k1, k2 = (H.mix((x[begin[1:]] - x[begin[:-1]]) + n.astype(np.uint64)).view(np.int64) for x in (one, two))
            _, key, _ = keys(sets, begin, percent)
            counts += np.bincount((key % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.uint32)
            salt = int(k1[0]) % 64 if len(k1) else 0
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("th"), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), none, none, pa.nulls(len(n), pa.binary())], schema=schema)
        if counts.any():
            blocks = range(-(-cells // BLOCK))
            none = pa.nulls(len(blocks), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(blocks, pa.int32()), pa.array([salt] * len(blocks), pa.int32()), pa.array([counts[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in blocks], pa.binary())], schema=schema)

    return map_arrow(rows.select("d", "th", "text"), run, "d long, th long, n long, k1 long, k2 long, block int, salt int, cells binary")


def _summed(df: DataFrame) -> DataFrame:
    """The sums of the count blocks of each partition, by block and salt; blocks are added as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, s, c in zip(*(batch.column(x).to_pylist() for x in ("block", "salt", "cells")), strict=True):
                c = np.frombuffer(c, np.uint32)
                have = sums.setdefault((b, s), np.zeros(len(c), np.uint32))
                have += np.minimum(c, np.iinfo(np.uint32).max - have)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "salt", "cells"])

    return map_arrow(df, run, "block int, salt int, cells binary")


def _frequency(profile: DataFrame, cells: int) -> bytes:
    """For each cell of the count sketch, 8 times the binary logarithm of its count, in one byte."""
    parts = profile.where("block is not null").select("block", "salt", "cells")
    first = _summed(parts.repartition(tasks(profile), "block", "salt"))
    last = _summed(first.withColumn("salt", F.lit(0)).repartition(tasks(profile), "block"))
    out = np.zeros(cells, np.uint8)
    for block, raw in last.select("block", "cells").collect():  # `cells` numbers in all, a parameter
        c = np.frombuffer(raw, np.uint32).astype(np.float64)
        out[block * BLOCK : block * BLOCK + len(c)] = np.minimum(255, np.floor(8 * np.log2(1 + c)))
    return out.tobytes()


def _sample(rows: DataFrame, size: int, percent: int, per: int) -> DataFrame:
    """(key, d): the `per` least keys of each sketch, by hash alone; equal sets of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH):
            sets, begin = shingles(*text_bytes(batch.column("text")), size)
            d = batch.column("d").to_numpy(zero_copy_only=False)
            sketch, key, few = keys(sets, begin, percent)
            keep = _leaders(sets, begin, d)[0][sketch // 2]
            order = np.argsort(sketch[keep], kind="stable")
            text, key = _first_keys(sketch[keep][order], key[keep][order], few[keep][order], np.full(len(d), per - 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(d[text])], names=["key", "d"])

    return map_arrow(rows.select("d", "text"), run, "key long, d long")


def _leaders(sets: np.ndarray, begin: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the least id of those with an equal set, hash of the set) of each text."""
    n = np.diff(begin)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(H.mix(sets), dtype=np.uint64)])
    same = H.mix((sums[begin[1:]] - sums[begin[:-1]]) + n.astype(np.uint64)).view(np.int64)
    order = np.lexsort((d, same))
    lead = np.zeros(len(d), bool)
    lead[order] = np.concatenate([[True], same[order][1:] != same[order][:-1]])[: len(d)]
    return lead, same


def _candidates(rows: DataFrame, size: int, percent: int, frequency: bytes) -> DataFrame:
    """(a, b) with a < b: for each shard, a spanning forest of the pairs of leaders of different components that share a key
    there and whose sketches are near enough to link. rows: d, text, c (component so far). A shard has some keys of one
    band, and each of its documents' sketches once."""
    cells = len(frequency)
    parts = max(1, tasks(rows) // 16)
    packed = pa.schema([("shard", pa.int32()), ("docs", pa.binary()), ("sketches", pa.binary()), ("counts", pa.binary()), ("sub", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.frombuffer(frequency, np.uint8)
        for batch in sub_batches(batches, "text", BATCH):
            sets, begin = shingles(*text_bytes(batch.column("text")), size)
            n = np.diff(begin)
            d, c = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("d", "c"))
            lead, same = _leaders(sets, begin, d)
            sketch, key, few = keys(sets, begin, percent)
            used = lead[sketch // 2]
            sketch, key, few = sketch[used], key[used], few[used]
            full = (freq[(key % np.uint64(cells)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | key
            ids = np.stack([d, same, c, n], axis=1).astype(np.int64)
            band = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            out = []
            for up in (0, 1):
                for k in np.unique(band[lead & (n > 0)]):
                    mine = ((sketch & 1) == up) & (band[sketch // 2] == k)
                    order = np.argsort(sketch[mine], kind="stable")
                    text, chosen = _first_keys(sketch[mine][order], full[mine][order], few[mine][order], allowed(n, percent))
                    if not len(text):
                        continue
                    text, chosen = _blocked(text, chosen, same)
                    width = int(words_of(k + up))
                    part = (chosen % np.uint64(parts)).astype(np.int64)
                    sub = ((chosen // np.uint64(parts)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    order = np.lexsort((text, part))
                    bounds = np.flatnonzero(np.diff(part[order], prepend=-1))
                    for i, j in zip(bounds, [*bounds[1:], len(order)], strict=True):
                        o = order[i:j]
                        who, counts = np.unique(text[o], return_counts=True)
                        out.append({"shard": int(k + up) * parts + int(part[o[0]]), "docs": squeeze(ids[who].T), "sketches": bits(sets, begin, who, width).tobytes(), "counts": squeeze(counts.astype(np.uint32)), "sub": sub[o].tobytes()})
            yield pa.RecordBatch.from_pylist(out, packed)

    def meet(t: pa.Table) -> pa.Table:
        width = int(words_of(t.column("shard")[0].as_py() // parts))
        ids = np.concatenate([unsqueezed([x], np.int64).reshape(4, -1) for x in t.column("docs").to_pylist()], axis=1)
        sketches = joined(t.column("sketches"), np.uint64).reshape(-1, width)
        entry = np.repeat(np.arange(ids.shape[1]), unsqueezed(t.column("counts").to_pylist(), np.uint32).astype(np.int64))
        sub = joined(t.column("sub"), np.uint32)
        del t
        d, same, c, n = ids
        order = np.lexsort((d, same))
        lead = np.zeros(len(d), bool)
        lead[order] = np.concatenate([[True], same[order][1:] != same[order][:-1]])
        used = lead[entry]
        a, b = _pairs(sub[used], entry[used], d, c, n, sketches, percent)
        del sketches, entry, sub, used
        release()
        x, y = np.minimum(d[a], d[b]), np.maximum(d[a], d[b])
        return pa.table({"a": x, "b": y})

    return map_arrow(rows.select("d", "c", "text"), send, "shard int, docs binary, sketches binary, counts binary, sub binary").groupBy("shard").applyInArrow(meet, "a long, b long").distinct()


def _blocked(text: np.ndarray, full: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of very many documents: each document goes to a block, and the key is told once for each pair of blocks."""
    hot = (full >> np.uint64(56)) >= int(8 * np.log2(1 + HOT))
    if not hot.any():
        return text, full
    out_text, out = [text[~hot]], [full[~hot]]
    for t, k in zip(text[hot].tolist(), full[hot], strict=True):
        blocks = int(2 ** (int(k >> np.uint64(56)) / 8) // HOT) + 2
        own, other = int(same[t]) % blocks, np.arange(blocks)
        pair = np.minimum(own, other) * blocks + np.maximum(own, other)
        out.append(H.mix(k + pair.astype(np.uint64)))
        out_text.append(np.full(blocks, t))
    return np.concatenate(out_text), np.concatenate(out)


def spanning(x: np.ndarray, y: np.ndarray, weight: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, weight) of the edges of a least spanning forest of edges between nodes that have the ids d. Equal weights are
    told apart by ids, so forests of parts of a graph have much in common."""
    order = np.lexsort((np.maximum(d[x], d[y]), np.minimum(d[x], d[y]), weight))
    x, y, weight = x[order], y[order], weight[order]
    root, out = np.arange(len(d)), []
    left = np.arange(len(x))
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            break
        best = np.full(len(d), len(x))
        np.minimum.at(best, root[x[left]], left)
        np.minimum.at(best, root[y[left]], left)
        pick = np.unique(best[best < len(x)])
        out.append(pick)
        root = _joined(root, x[pick], y[pick])
    pick = np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)
    return x[pick], y[pick], weight[pick]


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (the least node of each node's group), with the groups of each x and y made one."""
    a, b = root[x], root[y]
    low = np.arange(len(root))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == low).all():
            return low[root]
        low = new


def _pairs(sub: np.ndarray, doc: np.ndarray, d: np.ndarray, c: np.ndarray, n: np.ndarray, sketches: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of documents that share a `sub`, differ in c, and may link by sizes and sketches."""
    order = np.lexsort((doc, sub))
    sub, doc = sub[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]])) if len(sub) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(sub)))
    # Groups of one component have nothing left to find.
    if len(first):
        mixed = np.minimum.reduceat(c[doc], first) != np.maximum.reduceat(c[doc], first)
        first, count = first[mixed], count[mixed]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    width = sketches.shape[1]
    early = -(-2 * width // 5)  # words after which sets with little in common are too far apart already
    low, high, n = (100 * n).astype(np.int32), (percent * n).astype(np.int32), n.astype(np.int32)
    c = np.unique(c, return_inverse=True)[1].astype(np.int32)

    def rest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, first: int) -> None:
        """Compare the words from `first` on of few pairs."""
        most = (100 - percent) * (n[x].astype(np.int64) + n[y]) // (100 + percent)
        for w in range(first, width):
            apart = apart + np.bitwise_count(sketches[x, w] ^ sketches[y, w])
            if w + 1 == early:
                near = apart <= most
                x, y, apart, most = x[near], y[near], apart[near], most[near]
        near = apart <= most
        found.append((x[near], y[near], apart[near].astype(np.int64)))

    for k in np.unique(count).tolist():
        at = first[count == k]
        # Some groups of one size at a time, so that a matrix of all pairs has a million entries or so.
        some, part = max(1, (1 << 20) // (k * k)), max(1, (1 << 20) // k)
        for g in range(0, len(at), some):
            members = doc[at[g : g + some, None] + np.arange(k)]  # in order, so a pair is above the diagonal once
            right = [v[members][:, None, :] for v in (low, high, c)]
            for i in range(0, k, part):
                left = members[:, i : i + part]
                x = [v[left][:, :, None] for v in (low, high, c)]
                near = (x[0] >= right[1]) & (right[0] >= x[1]) & (x[2] != right[2])
                near &= np.arange(k)[None, None, :] > np.arange(i, i + left.shape[1])[None, :, None]
                p, u, v = np.nonzero(near)
                if 4 * len(p) < near.size:
                    rest(left[p, u], members[p, v], np.zeros(len(p), np.int32), 0)
                    continue
                apart = np.zeros(near.shape, np.uint16 if 64 * width < 1 << 16 else np.uint32)
                for w in range(early):
                    apart += np.bitwise_count(sketches[left, w][:, :, None] ^ sketches[members, w][:, None, :])
                near &= apart * np.int32(100 + percent) <= (100 - percent) * (n[left][:, :, None] + n[members][:, None, :])
                p, u, v = np.nonzero(near)
                rest(left[p, u], members[p, v], apart[p, u, v].astype(np.int32), early)
                if sum(len(f[0]) for f in found) > FOUND:
                    found = [spanning(*map(np.concatenate, zip(*found, strict=True)), d)]
    return spanning(*map(np.concatenate, zip(*found, strict=True)), d)[:2]


def _first_keys(sketch: np.ndarray, full: np.ndarray, few: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key): of each sketch the first most + 1 of its keys, and the shared key of those with too few."""
    bounds = np.flatnonzero(np.diff(sketch, prepend=-1))
    out_text, out = [], []
    for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(sketch)], strict=False):
        text = sketch[a] // 2
        k = int(most[text]) + 1
        part, extra = full[a:b], few[a:b]
        if extra.any():
            out.append(part[extra])
            out_text.append(np.full(int(extra.sum()), text))
            part = part[~extra]
        if len(part) > k:
            part = np.partition(part, k - 1)[:k]
        out.append(part)
        out_text.append(np.full(len(part), text))
    return (np.concatenate(out_text), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def measured(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """(a, b, na, nb, shared) of every pair: sizes of the two sets and of their intersection, by the words themselves."""
    pairs = pairs.select("a", "b")
    wanted = small(cut(pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct()))
    rows = rows.select("d", "text").join(wanted, "d", "left_semi")
    both = pairs.join(rows.select(F.col("d").alias("b"), F.col("text").alias("tb")), "b").join(rows.select(F.col("d").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "tb", BATCH // 4):
            k = batch.num_rows
            found, begin = named(*text_bytes(pa.concat_arrays([batch.column("ta"), batch.column("tb")])), size)
            n = np.diff(begin)
            key = np.repeat(np.arange(2 * k) % k, n) * (int(found.max(initial=0)) + 1) + found
            key.sort()
            shared = np.bincount(key[1:][key[1:] == key[:-1]] // (int(found.max(initial=0)) + 1), minlength=k)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n[:k]), pa.array(n[k:]), pa.array(shared)], names=["a", "b", "na", "nb", "shared"])

    return map_arrow(both.select("a", "b", "ta", "tb"), run, "a long, b long, na long, nb long, shared long")


def linked(percent: int) -> Column:
    return (F.col("shared") > 0) & (100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared")))


def _contested(arena: DataFrame, label: DataFrame) -> DataFrame:
    """(d, arena, c, odd, places): documents of the arenas that have several components; odd: outside of the arena's largest
    one; places: blocks (u, v) and whether the document is there as an odd one (to be compared with the others)."""
    docs = arena.withColumnRenamed("node", "d").join(label, "d", "left").select("d", F.col("component").alias("arena"), F.coalesce("c", "d").alias("c"))
    docs = cut(docs)
    sizes = docs.groupBy("arena", "c").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("arena").agg(F.sum("n").alias("n"), F.max(F.struct("n", F.col("c").alias("most"))).alias("t")).where("n > t.n")
    blocks = lambda n: F.ceil(n / ARENA).cast("int")
    sizes = small(cut(sizes.select("arena", "t.most", blocks(F.col("n")).alias("nv"), blocks(F.col("n") - F.col("t.n")).alias("nu"))))
    docs = docs.join(sizes, "arena").withColumn("odd", F.col("c") != F.col("most"))
    v, u = F.pmod(F.xxhash64("d"), F.col("nv")).cast("int"), F.pmod(F.xxhash64("d", F.lit(1)), F.col("nu")).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    here = each(F.col("nu"), lambda x: F.struct(x.alias("u"), v.alias("v"), F.lit(False).alias("asks")))
    asks = each(F.col("nv"), lambda x: F.struct(u.alias("u"), x.alias("v"), F.lit(True).alias("asks")))
    return docs.select("d", "arena", "c", "odd", F.when(F.col("odd"), F.concat(here, asks)).otherwise(here).alias("places"))


def _settled(rows: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest, of each task, of the links between components of contested arenas. docs: _contested()."""
    docs = small(cut(docs))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH):
            sets, begin = shingles(*text_bytes(batch.column("text")), size)
            packed = pa.array([squeeze(sets[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("d", "arena", "c", "odd", "places")), packed], names=["d", "arena", "c", "odd", "places", "sets"])

    made = map_arrow(rows.select("d", "text").join(docs, "d"), make, "d long, arena long, c long, odd boolean, places array<struct<u:int,v:int,asks:boolean>>, sets binary")
    made = made.select("d", "arena", "c", "odd", "sets", F.explode("places").alias("p")).select("d", "arena", "c", "odd", "sets", "p.*")

    def resolve(t: pa.Table) -> pa.Table:
        asks, odd = (np.array(t.column(x).to_pylist(), bool) for x in ("asks", "odd"))
        d, c = (t.column(x).to_numpy() for x in ("d", "c"))
        parts = [unsqueezed([x], np.uint64) for x in t.column("sets").to_pylist()]
        return pa.table(dict(zip(("a", "b"), _arena(d, c, odd, asks, parts, percent), strict=True)))

    return made.groupBy("arena", "u", "v").applyInArrow(resolve, "a long, b long")


def _arena(d: np.ndarray, c: np.ndarray, odd: np.ndarray, asks: np.ndarray, parts: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between those that ask and the others, each between two components that were not connected before."""
    n = np.array([len(x) for x in parts], np.int64)
    sets, begin = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(n)])
    width = int(min(WIDEST, words_of(np.floor(np.log2(max(1, n.max(initial=1)))))))
    sketch = bits(sets, begin, np.arange(len(n)), width)
    label = np.unique(c, return_inverse=True)[1]
    there = np.flatnonzero(~asks & (n > 0))
    out: list[tuple[int, int]] = []
    for x in np.flatnonzero(asks & (n > 0)).tolist():
        # Two odd ones meet twice, with the roles changed: the lesser id asks.
        y = there[(label[there] != label[x]) & (d[there] != d[x]) & ~(odd[there] & (d[there] < d[x]))]
        y = y[(100 * n[y] >= percent * n[x]) & (100 * n[x] >= percent * n[y])]
        apart = np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64)
        near = apart * (100 + percent) <= (100 - percent) * (n[x] + n[y])
        y = y[near][np.argsort(apart[near], kind="stable")]
        own = parts[x]
        while len(y):
            some, y = y[:64], y[64:]
            held = np.concatenate([parts[i] for i in some])
            at = np.minimum(np.searchsorted(own, held), len(own) - 1)
            shared = np.add.reduceat(own[at] == held, np.cumsum(n[some]) - n[some], dtype=np.int64)
            hit = some[100 * shared >= percent * (n[x] + n[some] - shared)]
            if len(hit):
                other, first = np.unique(label[hit], return_index=True)
                out += [(int(d[x]), int(d[i])) for i in hit[first]]
                label[np.isin(label, other)] = label[x]
                y = y[label[y] != label[x]]
    ends = np.array(out, np.int64).reshape(-1, 2)
    return ends.min(axis=1, initial=np.iinfo(np.int64).max), ends.max(axis=1, initial=np.iinfo(np.int64).min)


def classes(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, cells: int = CELLS) -> DataFrame:
    """(d, th, n_shingles, component_id) of every row that has an id; d, th: id and xxhash64 of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    profile = cut(_profile(rows, size, percent, cells))
    docs = profile.where("block is null").select("d", "th", "n", "k1", "k2")
    # A first round from few keys finds most links; it only spares the second round pairs that are connected anyway.
    some = cut(_sample(rows, size, percent, SOME))
    # The center of a key is the document that shares its keys most widely: of edited copies, the one edited least.
    shared = small(cut(some.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")))
    some = cut(some.join(shared, "key"))
    some = cut(some.select("key", "d").join(some.groupBy("d").agg(F.sum("m").alias("m")), "d"))
    center = small(cut(some.groupBy("key").agg(F.max(F.struct("m", (-F.col("d")).alias("a"))).alias("t")).select("key", (-F.col("t.a")).alias("a"))))
    stars = some.join(center, "key").where("d <> a").groupBy("a", F.col("d").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    best = cut(stars.groupBy("b").agg(F.max(F.struct("c", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b"))
    links = cut(measured(best, rows, size).where(linked(percent)).select("a", "b").distinct())
    label = lambda e: small(components(e).select(F.col("node").alias("d"), F.col("component").alias("c")))
    known = rows.join(label(links), "d", "left").select("d", "text", F.coalesce("c", "d").alias("c"))
    near = cut(_candidates(known, size, percent, _frequency(profile, cells)))
    if not near.isEmpty():
        links = cut(links.unionByName(measured(near, rows, size).where(linked(percent)).select("a", "b")))
        more = cut(_settled(rows, _contested(components(near), label(links)), size, percent).distinct())
        links = links.unionByName(measured(more, rows, size).where(linked(percent)).select("a", "b"))

    equal = small(cut(docs.where("n > 0").groupBy("k1", "k2").agg(F.min("d").alias("lead"), F.max("d").alias("last")).where("lead <> last").select("k1", "k2", "lead")))
    docs = docs.join(equal, ["k1", "k2"], "left").select("d", "th", "n", F.when(F.col("n") > 0, F.coalesce("lead", "d")).otherwise(F.col("d")).alias("lead"))
    docs = cut(docs)
    # A repeated id is one node, whatever its texts.
    links = links.unionByName(docs.where("d <> lead").select(F.col("lead").alias("a"), F.col("d").alias("b")))
    out = docs.join(components(links).withColumnRenamed("node", "d"), "d", "left")
    return out.select("d", "th", F.col("n").alias("n_shingles"), F.coalesce("component", "d").alias("component_id")).distinct()


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def with_components(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """df's rows with n_shingles and component_id added (null for a row without id), in place of columns so named."""
    found = classes(df, id_col=id_col, text_col=text_col, size=size, percent=percent)
    d, th = fresh(df, "d", "th")
    rows = df.drop("n_shingles", "component_id").withColumns({d: F.col(id_col).cast("long"), th: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return rows.join(found.select(F.col("d").alias(d), F.col("th").alias(th), "n_shingles", "component_id"), [d, th], "left").drop(d, th)


ORACLE_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (select distinct doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') x from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i from w where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id root from documents union select e.b, r.root from r join e on r.doc_id = e.a)
select documents.doc_id, coalesce(n.n, 0)::bigint n_shingles, component_id from documents left join n using (doc_id) join (select doc_id, min(root) component_id from r group by doc_id) using (doc_id)
"""
