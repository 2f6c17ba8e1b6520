"""Windows of a fixed length that also start in a document with a smaller id: the distributed part.

A text is a row of units (bytes or words). `lengths` are window lengths, each at most twice the one before; windows of the
last one are what is looked for. A window of one length shows one window of the length before: that with the least hash
in it, the leftmost if several are equal. Equal windows show equal ones, at the same place. So, level by level,

1. shown windows of all texts meet by hash (`live`): one that occurs in a single document is repeated nowhere, and only
   around the others are windows of the next length made; with no candidate left, later levels have nothing to read;
2. at the last level, the run of windows that show the same one is sent, as its content, to where all runs of that one
   meet (`repeated`); there the operator's own method finds which windows are equal, and the least document of each;
3. what is found comes back as runs of windows (`marked`).

The texts are dealt once to buckets, by a hash of id and text, as many as a shuffle has partitions. A bucket's texts have
an order (by id and hash), so a unit's place in its bucket stands for its document: what is sent holds no ids of texts,
and its size hardly depends on how many shards there are. Shown windows and runs travel as packed arrays, a row for a
shard and a bucket. Of shown windows those are the different hashes, and the live ones among them come back. Of the runs of
a bucket that have the same content those of the least document are sent, and the others are settled at once. So a group
of copies costs a shard one entry a bucket, not one a copy. Hashes choose candidates only, where a false match costs time;
contents count as equal when their bytes are.

Defined cases: an empty table has no windows; texts may be of any length (a batch has one text at least, and memory grows
with the longest text, and with the texts of a bucket); of df only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import hashes as H
from lodestar.llm.common import LAST_ID, hold, release, squeeze, sub_batches, tasks, text_bytes, unsqueezed
from lodestar.llm.native import keyed

PART = 1 << 19  # bytes of contents that a shard compares at a time, if no shown window has more
FLUSH = 1 << 26  # bytes of contents that a bucket holds before they are sent
PLACE = 24  # bits that hashes of shown windows leave for a place


class Bytes:
    """Texts of a batch as bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(data)

    def grams(self, n: int) -> np.ndarray:
        m = self.n - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        view = H.eights(self.data)
        out = view[:m] & H._MASK[min(n, 8)]
        for at in range(8, n, 8):
            out = H.fold(out, view[at : at + m] & H._MASK[min(n - at, 8)])
        return H.mix(out) if n <= 8 else out

    def contents(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, start, end) of runs of units."""
        return self.data, start, end


class Words:
    """Texts of a batch as words; a content is its words, joined by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.start, self.end, self.offsets = H.bounds(data, offsets)
        self.n = len(self.start)

    def grams(self, n: int) -> np.ndarray:
        return H.grams(H.spans(self.data, self.start, self.end), n)

    def contents(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.end - self.start
        last = np.cumsum(size + 1) - 1
        out = np.full(int(last[-1]) + 1 if self.n else 0, 32, np.uint8)
        solid = np.ones(len(out), bool)
        solid[last] = False
        out[solid] = self.data[_spans(self.start, size)]
        return out, (last - size)[start], last[end - 1]


#: Bytes or Words: the units of a batch.
Units = Callable[[np.ndarray, np.ndarray], "Bytes | Words"]
#: From contents (bytes, size and number of windows of each) to the class of each window of each, in turn.
Method = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def sliding_argmin(values: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` values, the place of the least (the leftmost of equal ones)."""
    at, low, have = np.arange(len(values)), values, 1
    while have < span:
        step = min(have, span - have)
        right = low[step:] < low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        have += step
    return at


def shown(grams: np.ndarray, span: int) -> np.ndarray:
    """As sliding_argmin() of the hashes without their last PLACE bits: one minimum of hash and place together."""
    high = grams >> np.uint64(PLACE)
    if len(grams) >= 1 << PLACE:
        return sliding_argmin(high, span)
    low, have = (high << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64), 1
    while have < span:
        step = min(have, span - have)
        low, have = np.minimum(low[step:], low[:-step]), have + step
    return (low & np.uint64((1 << PLACE) - 1)).astype(np.int64)


def runs(units, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of `length` that show one window of `gram`: text, first window, windows, place and hash of what they show."""
    none = np.zeros(0, np.int64)
    if units.n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    g = units.grams(gram)
    at = shown(g, length - gram + 1)[: units.n - length + 1]
    # A window that runs on into the next text is none.
    whole = _spans(units.offsets[:-1], np.maximum(np.diff(units.offsets) - length + 1, 0))
    if not len(whole):
        return none, none, none, none, np.zeros(0, np.uint64)
    at = at[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(whole)))
    start, at = whole[first], at[first]
    text = np.searchsorted(units.offsets, start, side="right") - 1
    return text, start, count, at, g[at]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indexes start[i] .. start[i] + size[i] - 1, for all i in turn."""
    if not size.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)


def planes(values: np.ndarray) -> bytes:
    """squeeze() of numbers below 2^32, first the last byte of each, then the next: small numbers take few bytes."""
    return squeeze(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def unplaned(part: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueezed([part], np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def steps(values: np.ndarray) -> bytes:
    """planes() of the differences of rising numbers."""
    return planes(np.diff(values.astype(np.int64), prepend=0))


def unstepped(part: bytes) -> np.ndarray:
    return np.cumsum(unplaned(part))


def even(n: int) -> np.ndarray:
    """n numbers that Spark's hash deals to n different partitions of n."""
    out, left, begin = np.full(n, -1, np.int64), n, 0
    while left:
        k = np.arange(begin, begin + 4 * n + 64, dtype=np.uint32)
        h = k * np.uint32(0xCC9E2D51)
        h = ((h << np.uint32(15)) | (h >> np.uint32(17))) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        part = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n
        found, at = np.unique(part, return_index=True)
        new = out[found] < 0
        out[found[new]] = k[at[new]]
        left, begin = int((out < 0).sum()), begin + len(k)
    return out


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema)


def _texts(bucket: pa.Table, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The bucket's texts in its order, in batches of about `most` bytes, with the d of each."""
    d, th = (bucket.column(x).to_numpy() for x in ("d", "th"))
    order = np.lexsort((th, d))
    texts = bucket.select(["d", "text"]).set_column(1, "text", bucket.column("text").cast(pa.large_string())).take(order)
    for batch in sub_batches(texts.combine_chunks().to_batches(), "text", most):
        yield batch, batch.column("d").to_numpy()


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, its entries in their order) of each shard there is."""
    order = np.argsort(shard, kind="stable")
    bounds = [*np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist(), len(order)]
    for i, j in pairwise(bounds):
        yield int(shard[order[i]]), order[i:j]


def _split(fp: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, what tells hashes of a shard apart)."""
    return (fp % np.uint64(shards)).astype(np.int64), (fp >> np.uint64(32)).astype(np.int64)


class _Live:
    """The hashes that are live, of those a bucket has told."""

    def __init__(self, replies: pa.Table, shards: int):
        self.shards = shards
        parts = [(s << 32) + unstepped(x) for s, x in zip(*(replies.column(c).to_pylist() for c in ("shard", "live")), strict=True)]
        self.keys = np.sort(np.concatenate([np.zeros(0, np.int64), *parts]))

    def has(self, fp: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(fp), bool)
        shard, sub = _split(fp, self.shards)
        key = (shard << 32) + sub
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key


def _least(group: np.ndarray, n: int, d: np.ndarray) -> np.ndarray:
    low = np.full(n, np.iinfo(np.int64).max, np.int64)
    np.minimum.at(low, group, d)
    return low


_TOLD = pa.schema([("shard", pa.int32()), ("b", pa.int32()), ("sub", pa.binary()), ("many", pa.binary())])
_LIVE = pa.schema([("b", pa.int32()), ("shard", pa.int32()), ("live", pa.binary())])


def live(texts: DataFrame, known: DataFrame | None, units: Units, lengths: tuple[int, ...], most: int) -> DataFrame:
    """(b, shard, live): those hashes of a bucket's shown windows that more than one document has. texts: b, d, th, text;
    lengths: of the windows that are live so far (by `known`), if there are any, of those looked up, of those that show
    them."""
    shards = tasks(texts)
    deal = even(shards).astype(np.int32)
    gram, length = lengths[-2:]

    def tell(bucket: pa.Table, before: _Live | None) -> pa.Table:
        hold("repeats", lambda: None)
        fps, many = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch, ids in _texts(bucket, most):
            u = units(*text_bytes(batch.column("text")))
            text, _, _, at, fp = runs(u, length, gram)
            if before is not None and len(text):
                # Only windows around one that is live at the length before are still candidates.
                g = u.grams(lengths[-3])
                keep = before.has(g[shown(g, gram - lengths[-3] + 1)[at]])
                text, fp = text[keep], fp[keep]
            if not len(text):
                continue
            # Texts of a batch are in the order of d.
            order = np.argsort(fp, kind="stable")
            d, fp = ids[text][order], fp[order]
            first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
            fps.append(fp[first])
            low.append(d[first])
            high.append(d[np.append(first[1:], len(fp)) - 1])
        fp, low, high = map(np.concatenate, (fps, low, high))
        del fps
        if not len(fp):
            return _TOLD.empty_table()
        order = np.argsort(fp, kind="stable")
        fp, low, high = fp[order], low[order], high[order]
        first = np.flatnonzero(np.append(True, fp[1:] != fp[:-1]))
        many = low[first] < high[np.append(first[1:], len(fp)) - 1]
        # Rising hashes have rising subs.
        shard, sub = _split(fp[first], shards)
        b = bucket.column("b")[0].as_py()
        out = [{"shard": int(deal[s]), "b": b, "sub": steps(sub[o]), "many": squeeze(np.packbits(many[o]))} for s, o in _by_shard(shard)]
        release()
        return _rows(out, _TOLD)

    def meet(table: pa.Table) -> pa.Table:
        # Where a sub occurs twice, several buckets have it (or two hashes, which costs time only).
        subs = [unstepped(x) for x in table.column("sub").to_pylist()]
        size = np.array([len(x) for x in subs])
        many = np.concatenate([np.unpackbits(unsqueezed([x], np.uint8), count=n) for x, n in zip(table.column("many").to_pylist(), size.tolist(), strict=True)]).astype(bool)
        sub = np.concatenate(subs)
        order = np.argsort(sub, kind="stable")
        first = np.flatnonzero(np.append(True, sub[order][1:] != sub[order][:-1]))
        count = np.diff(np.append(first, len(sub)))
        many[order] = np.repeat((count > 1) | np.logical_or.reduceat(many[order], first), count)
        ends = np.cumsum(size)
        shard = np.flatnonzero(deal == table.column("shard")[0].as_py())[0]
        out = [{"b": b, "shard": int(shard), "live": steps(sub[i:j][many[i:j]])} for b, i, j in zip(table.column("b").to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True) if many[i:j].any()]
        return _rows(out, _LIVE)

    told = "shard int, b int, sub binary, many binary"
    if known is None:
        sent = texts.groupBy("b").applyInArrow(lambda bucket: tell(bucket, None), told)
    else:
        sent = texts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(lambda bucket, found: tell(bucket, _Live(found, shards)) if len(found) else _TOLD.empty_table(), told)
    return sent.groupBy("shard").applyInArrow(meet, "b int, shard int, live binary")


_SENT = pa.schema([("shard", pa.int32()), ("b", pa.int32()), ("settled", pa.bool_()), *((n, pa.binary()) for n in ("start", "count", "sub", "d", "sizes", "body"))])
_FOUND = pa.schema([("b", pa.int32()), ("start", pa.binary()), ("n", pa.binary())])


def repeated(texts: DataFrame, known: DataFrame, units: Units, lengths: tuple[int, ...], method: Method, most: int) -> DataFrame:
    """(b, start, n): runs of windows (first unit in the bucket, how many) that also start in a smaller document."""
    shards = tasks(texts)
    deal = even(shards).astype(np.int32)
    gram, length = lengths[-2:]

    def pack(b: int, d: np.ndarray, start: np.ndarray, count: np.ndarray, fp: np.ndarray, body: np.ndarray, size: np.ndarray) -> Iterator[dict]:
        begin = np.cumsum(size) - size
        group, n = H.exact(body, begin, begin + size, fp, H.spans(body, begin, begin + size))
        least = d == _least(group, n, d)[group]
        done = np.flatnonzero(~least)
        if len(done):
            yield {"shard": int(deal[b % shards]), "b": b, "settled": True, "start": steps(start[done]), "count": planes(count[done])}
        open_ = np.flatnonzero(least)
        shard, sub = _split(fp[open_], shards)
        for s, o in _by_shard(shard):
            e = open_[o]
            row = {"shard": int(deal[s]), "b": b, "settled": False, "start": steps(start[e]), "count": planes(count[e]), "sub": planes(sub[o]), "d": squeeze(np.diff(d[e], prepend=0))}
            yield row | {"sizes": None if units is Bytes else planes(size[e]), "body": squeeze(body[_spans(begin[e], size[e])])}

    def send(bucket: pa.Table, replies: pa.Table) -> pa.Table:
        hold("repeats", lambda: None)
        out, have, base = [], [], 0
        if not len(replies):
            return _SENT.empty_table()
        b, found = bucket.column("b")[0].as_py(), _Live(replies, shards)
        for batch, ids in _texts(bucket, most):
            u = units(*text_bytes(batch.column("text")))
            text, start, count, _, fp = runs(u, length, gram)
            keep = found.has(fp)
            text, start, count, fp = text[keep], start[keep], count[keep], fp[keep]
            if len(text):
                body, begin, end = u.contents(start, start + count + length - 1)
                have.append((ids[text], base + start, count, fp, body[_spans(begin, end - begin)], end - begin))
            base += u.n
            if sum(len(x[4]) for x in have) > FLUSH:
                out += pack(b, *map(np.concatenate, zip(*have, strict=True)))
                have = []
        if have:
            out += pack(b, *map(np.concatenate, zip(*have, strict=True)))
        del have
        release()
        return _rows(out, _SENT)

    def meet(table: pa.Table) -> pa.Table:
        out = [{"b": b, "start": x, "n": n} for b, x, n, done in zip(*(table.column(c).to_pylist() for c in ("b", "start", "count", "settled")), strict=True) if done]
        table = table.filter(pc.invert(table.column("settled")))
        if not len(table):
            return _rows(out, _FOUND)
        read = lambda name, fn: [fn(x) for x in table.column(name).to_pylist()]
        first = read("start", unstepped)
        ends = np.cumsum([len(x) for x in first])
        first, count, sub = (np.concatenate(x) for x in (first, read("count", unplaned), read("sub", unplaned)))
        d = np.concatenate(read("d", lambda x: np.cumsum(unsqueezed([x], np.int64))))
        body = unsqueezed(table.column("body").to_pylist(), np.uint8)
        size = count + length - 1 if units is Bytes else np.concatenate(read("sizes", unplaned))
        buckets = table.column("b").to_pylist()
        del table
        begin = np.cumsum(size) - size
        group, n = H.exact(body, begin, begin + size, sub, H.spans(body, begin, begin + size))
        low, rep = _least(group, n, d), H.firsts(group, n)
        # Anchors with one content need no comparison; the contents of the others are compared window by window.
        of_anchor = np.unique(sub[rep], return_inverse=True)[1] if n else np.zeros(0, np.int64)
        mixed = np.flatnonzero(np.bincount(of_anchor, minlength=1)[of_anchor] > 1) if n else np.zeros(0, np.int64)
        windows = count[rep] if n else np.zeros(0, np.int64)
        least = np.repeat(low, windows)
        at_window = np.cumsum(windows) - windows
        # Some anchors at a time, all contents of an anchor together.
        mixed = mixed[np.argsort(of_anchor[mixed], kind="stable")]
        bounds = np.flatnonzero(np.diff(of_anchor[mixed], prepend=-1))
        total = np.concatenate([[0], np.cumsum(size[rep[mixed]])])
        i = 0
        while i < len(mixed):
            ahead = bounds[(bounds > i) & (total[bounds] - total[i] <= PART)]
            after = bounds[bounds > i]
            j = int(ahead[-1] if len(ahead) else after[0] if len(after) else len(mixed))
            if total[-1] - total[i] <= PART:
                j = len(mixed)
            some, i = mixed[i:j], j
            cls = method(body[_spans(begin[rep[some]], size[rep[some]])], size[rep[some]], windows[some])
            best = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max, np.int64)
            np.minimum.at(best, cls, np.repeat(low[some], windows[some]))
            least[_spans(at_window[some], windows[some])] = best[cls]
        each = _spans(at_window[group], count)
        entry = np.repeat(np.arange(len(d)), count)
        hit = least[each] < d[entry]
        place = first[entry] + (np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count))
        new = hit.copy()
        new[1:] &= ~(hit[:-1] & (entry[1:] == entry[:-1]))
        stop = hit.copy()
        stop[:-1] &= ~(hit[1:] & (entry[1:] == entry[:-1]))
        i, j = np.flatnonzero(new), np.flatnonzero(stop)
        place, n, row = place[i], j - i + 1, np.searchsorted(ends, entry[i], side="right")
        for r, o in _by_shard(row):
            out.append({"b": buckets[r], "start": steps(place[o]), "n": planes(n[o])})
        return _rows(out, _FOUND)

    sent = "shard int, b int, settled boolean, start binary, count binary, sub binary, d binary, sizes binary, body binary"
    return texts.groupBy("b").cogroup(known.groupBy("b")).applyInArrow(send, sent).groupBy("shard").applyInArrow(meet, "b int, start binary, n binary")


#: From a batch (d, text), its units and which of them are covered, to the rows of the result without the id.
Finish = Callable[[pa.RecordBatch, "Bytes | Words", np.ndarray], list[dict]]


def marked(df: DataFrame, units: Units, lengths: tuple[int, ...], method: Method, finish: Finish, columns: str, schema: pa.Schema, *, id_col: str, text_col: str, most: int) -> DataFrame:
    """doc_id and what `finish` makes (columns, as Spark and Arrow name them) of every row of df."""
    rows = keyed(df, id_col, text_col)
    n, length = tasks(rows), lengths[-1]
    deal = F.element_at(F.lit(even(n).tolist()), (F.pmod(F.xxhash64("d", "th"), F.lit(n)) + 1).cast("int"))
    # One exchange of the texts serves all steps.
    texts = rows.select(deal.cast("int").alias("b"), "d", "th", "text")
    at, known = None, ()
    for gram, wide in pairwise(lengths):
        at, known = live(texts, at, units, (*known, gram, wide), most), (gram,)
    found = repeated(texts, at, units, lengths, method, most)
    schema = schema.insert(0, pa.field("doc_id", pa.int64()))

    def end(bucket: pa.Table, replies: pa.Table) -> pa.Table:
        hold("repeats", lambda: None)
        starts = np.concatenate([np.zeros(0, np.int64), *map(unstepped, replies.column("start").to_pylist())])
        counts = np.concatenate([np.zeros(0, np.int64), *map(unplaned, replies.column("n").to_pylist())])
        order = np.argsort(starts)
        starts, counts = starts[order], counts[order]
        out, base = [schema.empty_table()], 0
        for batch, ids in _texts(bucket, most):
            u = units(*text_bytes(batch.column("text")))
            i, j = np.searchsorted(starts, [base, base + u.n])
            step = np.zeros(u.n + 1, np.int64)
            np.add.at(step, starts[i:j] - base, 1)
            np.add.at(step, starts[i:j] - base + counts[i:j] + length - 1, -1)
            made = finish(batch, u, np.cumsum(step[:-1]) > 0)
            out.append(pa.Table.from_pylist([{"doc_id": int(d) if d != LAST_ID else None} | x for d, x in zip(ids.tolist(), made, strict=True)], schema))
            base += u.n
        return pa.concat_tables(out)

    return texts.groupBy("b").cogroup(found.groupBy("b")).applyInArrow(end, f"doc_id long, {columns}")
