"""Hashes of words, windows and spans over whole Arrow batches with numpy, and comparisons of what they stand for.

Values are folded two at a time through a multiplication and shifts, so no arithmetic relation between words or places
makes hashes equal. Where equal hashes decide a result, `same_spans` compares the bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np

LONG = 1024  # bytes of a span from which on a digest is taken
_K1, _K2, _S = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), (np.uint64(32), np.uint64(29))
#: Which bits of 8 little-endian bytes belong to a span that has 0 to 8 of them left.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= _K2
    x ^= x >> np.uint64(32)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def fold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for each two, in this order."""
    x = a * _K1
    x += b
    x ^= x >> _S[0]
    x *= _K2
    x ^= x >> _S[1]
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the 8 bytes from each byte on; past the end come zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, view: np.ndarray | None = None) -> np.ndarray:
    """The hash of data[start:end] for each pair. view: eights(data), if it is there already."""
    view = eights(data) if view is None else view
    size = end - start
    out = size.astype(np.uint64)
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at, size = start[left], size[left]
    while len(left):
        out[left] = fold(out[left], view[at] & _MASK[np.minimum(size, 8)])
        more = size > 8
        left, at, size = left[more], at[more] + 8, size[more] - 8
    for i in np.flatnonzero(end - start > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span equal those of the span number `other`."""
    view = eights(data)
    size = end - start
    out = size == size[other]
    left = np.flatnonzero(out & (size > 0) & (other != np.arange(len(other))))
    a, b, size = start[left], start[other[left]], size[left]
    while len(left):
        equal = ((view[a] ^ view[b]) & _MASK[np.minimum(size, 8)]) == 0
        out[left[~equal]] = False
        more = equal & (size > 8)
        left, a, b, size = left[more], a[more] + 8, b[more] + 8, size[more] - 8
    return out


def classes(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(class of each entry, classes): entries with equal keys have one class."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, int(new.sum())


def firsts(number: np.ndarray, n: int) -> np.ndarray:
    """The first entry of each of n classes."""
    out = np.full(n, -1, np.int64)
    out[number[::-1]] = np.arange(len(number))[::-1]
    return out


def exact(data: np.ndarray, start: np.ndarray, end: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(class of each span, classes): spans with equal keys and equal bytes have one class. keys hold a hash of the
    bytes, so nearly always the bytes of a class are found equal at once; if not, each is looked up whole."""
    number, n = classes(*keys)
    if not n or same_spans(data, start, end, firsts(number, n)[number]).all():
        return number, n
    seen: dict[tuple[int, bytes], int] = {}
    out = [seen.setdefault((k, data[a:b].tobytes()), len(seen)) for k, a, b in zip(number.tolist(), start.tolist(), end.tolist(), strict=True)]
    return np.array(out, np.int64), len(seen)


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n values in a row, folded from those of half as many."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    have, out = 1, values
    while have < n:
        step = min(have, n - have)
        out, have = fold(out[: len(out) - step], out[step:]), have + step
    return out


def sequences(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of values[start:end] for each pair."""
    out = (end - start).astype(np.uint64)
    left, at = np.flatnonzero(end > start), start[end > start]
    while len(left):
        out[left] = fold(out[left], values[at])
        more = at + 1 < end[left]
        left, at = left[more], at[more] + 1
    return out


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words before each text) of the words of texts that lie in data between offsets.

    Words are runs of bytes other than 0x20 and 0x09 to 0x0D.
    """
    solid = (data != 32) & ((data < 9) | (data > 13))
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = solid[cut]
    stop[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, words before each text) of all words, see bounds(); lower: A-Z count as a-z."""
    start, end, at = bounds(data, offsets)
    return start, end, spans(_LOWER[data] if lower else data, start, end), at
