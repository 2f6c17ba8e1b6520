"""Suffix order by the difference-cover algorithm, with numpy.

Suffixes at positions that are 1 or 2 modulo 3 are sorted by their first three symbols; the triples' names form a string
of two thirds the length, whose suffix order (by recursion) orders those suffixes; the remaining ones are sorted by their
first symbol and the rank that follows, and both lists are merged. Recursion stops as soon as all names differ.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of text (non-negative integers) in the order of their suffixes; a shorter suffix comes first."""
    return _order(np.asarray(text, np.int64) + 1)


def _names(a: np.ndarray, b: np.ndarray, c: np.ndarray, size: int) -> np.ndarray:
    """Ranks from 1 of the triples (a, b, c), equal for equal ones."""
    if size < 1 << 20:
        key = (a * size + b) * size + c
    else:
        pair = np.unique(a * size + b, return_inverse=True)[1]
        key = pair * size + c
    return np.unique(key, return_inverse=True)[1] + 1


def _order(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    size = int(t.max()) + 1
    p = np.concatenate([t, np.zeros(4, np.int64)])
    # With n = 1 modulo 3 an empty suffix ends the first third, so that the thirds don't run into each other.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    cover = np.concatenate([one, two])
    names = _names(p[cover], p[cover + 1], p[cover + 2], size)
    if names.max() == len(cover):
        sub = np.argsort(names, kind="stable")
    else:
        sub = _order(names)
    rank = np.zeros(n + 4, np.int64)
    rank[cover[sub]] = np.arange(1, len(cover) + 1)
    sampled = cover[sub]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(p[zero] * (n + 4) + rank[zero + 1], kind="stable")]
    # How many of the other list come before each: against those at 1 modulo 3 by (symbol, rank), at 2 by (two symbols, rank).
    first, second = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    single = lambda i: p[i] * (n + 4) + rank[i + 1]
    if size * size * (n + 4) < 1 << 62:
        pair = lambda i: p[i] * size + p[i + 1]
        double = lambda i: pair(i) * (n + 4) + rank[i + 2]
    else:
        both = np.concatenate([zero, second])
        dense = np.zeros(n, np.int64)
        dense[both] = np.unique(p[both] * size + p[both + 1], return_inverse=True)[1]
        double = lambda i: dense[i] * (n + 4) + rank[i + 2]
    before = np.searchsorted(single(first), single(zero)) + np.searchsorted(double(second), double(zero))
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + before
    taken = np.zeros(n, bool)
    taken[at] = True
    out[at] = zero
    out[~taken] = sampled
    return out


def equal_windows(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For each start, the number of its class: starts have one class if the `length` symbols there are equal.

    Adjacent suffixes in suffix order are compared symbol by symbol.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    wanted = np.full(len(text), -1, np.int64)
    wanted[starts] = np.arange(len(starts))
    order = suffix_order(text)
    order = order[wanted[order] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(text, length)
    new = np.ones(len(order), bool)
    for i in range(1, len(order), 1 << 16):
        j = min(len(order), i + (1 << 16))
        new[i:j] = (views[order[i:j]] != views[order[i - 1 : j - 1]]).any(axis=1)
    out = np.empty(len(starts), np.int64)
    out[wanted[order]] = np.cumsum(new) - 1
    return out
