"""Suffix arrays in numpy: Larsson-Sadakane refinement, Kasai common prefixes, merging by binary search.

A shard is a text of pieces behind one another.  What counts are the windows of WINDOW bytes that lie within a piece.  Two windows are
equal iff they are neighbours by common prefixes of at least WINDOW in the shard's suffix array.
"""

from __future__ import annotations

import numpy as np

WINDOW = 100
PAD = WINDOW + 64
LANE = 256


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a little-endian number (text has at least seven bytes to spare)."""
    return np.ndarray((len(text) - 7,), "<u8", text.data, strides=(1,))


def suffix_array(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the n suffixes of text[:n]; text is padded beyond n, and a suffix comes before those it begins.

    The first round sorts by eight bytes.  Every further round doubles the depth: within groups that are still equal, suffix i is
    sorted by the rank of suffix i + h; groups of one are finished and aren't touched again.
    """
    big = words_at(text)[:n].byteswap()
    tail = max(0, n - 7)
    laid = np.concatenate((np.arange(n - 1, tail - 1, -1), np.arange(tail)))  # suffixes that reach the padding: shortest first
    order = laid[np.argsort(big[laid], kind="stable")]
    rank = np.empty(n + PAD, np.int64)
    rank[n:] = -1
    new = np.ones(n, bool)
    new[1:] = (big[order[1:]] != big[order[:-1]]) | (order[:-1] >= tail)
    starts = np.flatnonzero(new)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    h = 8
    while h < n:
        size = np.diff(np.append(starts, n))
        open_ = np.repeat(size > 1, size)
        at = np.flatnonzero(open_)
        if not len(at):
            break
        own = order[at]
        second = rank[np.minimum(own + h, n + PAD - 1)] + 1
        key = rank[own] * (n + 1) + second
        inner = np.argsort(key, kind="stable")
        own, key = own[inner], key[inner]
        order[at] = own
        new[at[1:]] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
        h *= 2
    rank[order] = np.arange(n)
    return order, rank[:n]


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Per position the common prefix with its predecessor in the array, up to `most`: Kasai's walk, in many lanes at once.

    Every lane goes through its positions from left to right; a position's common prefix is at least that of the position
    before it less one, so a lane only compares what is new.
    """
    n = len(order)
    words = words_at(text)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    found = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    h = np.zeros(len(lanes), np.int64)
    for step in range(min(LANE, n)):
        i = lanes + step
        i = i[i < n]
        h = np.maximum(h[: len(i)] - 1, 0)
        j = before[i]
        h[j < 0] = 0
        active = np.flatnonzero((j >= 0) & (h < most))
        while len(active):
            a = i[active] + h[active]
            differ = words[a] ^ words[j[active] + h[active]]
            low = differ & (~differ + np.uint64(1))
            h[active] += np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            active = active[(differ == 0) & (h[active] < most)]
        h = np.minimum(h, most)
        found[i] = h
    return found


def classes(text: np.ndarray, n: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each window, a window of each class); classes are numbered in the order of their bytes."""
    order, rank = suffix_array(text, n)
    prefixes = common_prefixes(text, order, rank)
    number = np.cumsum(prefixes[order] < WINDOW)
    own = number[rank[windows]]
    distinct, first, inverse = np.unique(own, return_index=True, return_inverse=True)
    return inverse, windows[first]


def compare(a_text: np.ndarray, a: np.ndarray, b_text: np.ndarray, b: np.ndarray) -> np.ndarray:
    """-1, 0, 1 for windows at a against windows at b, by eight bytes at a time."""
    x, y = words_at(a_text), words_at(b_text)
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for off in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        p, q = x[a[open_] + off].byteswap(), y[b[open_] + off].byteswap()
        out[open_] = np.where(p == q, 0, np.where(p < q, -1, 1))
        open_ = open_[p == q]
        if not len(open_):
            break
    return out


def search(text: np.ndarray, sorted_windows: np.ndarray, other: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted window of the other shard among a shard's sorted distinct windows, or -1."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(sorted_windows), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        less = compare(text, sorted_windows[middle], other, wanted[open_]) < 0
        low[open_] = np.where(less, middle + 1, low[open_])
        high[open_] = np.where(less, high[open_], middle)
    found = np.full(len(wanted), -1, np.int64)
    inside = np.flatnonzero(low < len(sorted_windows))
    same = compare(text, sorted_windows[low[inside]], other, wanted[inside]) == 0
    found[inside[same]] = low[inside[same]]
    return found


def not_first(shards: list[tuple[np.ndarray, np.ndarray]], place: list[np.ndarray]) -> list[np.ndarray]:
    """For (padded text, windows) shards and the windows' places in the corpus: which windows also start at an earlier place.

    Every shard has its own array; distinct windows of each two shards meet by binary search of one's in the other's.
    """
    known = []
    for (text, windows), order in zip(shards, place, strict=True):
        own, distinct = classes(text, len(text) - PAD, windows)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, own, order)
        known.append((own, distinct, least))
    first = [k[2].copy() for k in known]
    for a in range(len(shards)):
        for b in range(a + 1, len(shards)):
            at = search(shards[a][0], known[a][1], shards[b][0], known[b][1])
            hit = np.flatnonzero(at >= 0)
            first[b][hit] = np.minimum(first[b][hit], known[a][2][at[hit]])
            first[a][at[hit]] = np.minimum(first[a][at[hit]], known[b][2][hit])
    return [order > least[own] for (own, _, _), order, least in zip(known, place, first, strict=True)]
