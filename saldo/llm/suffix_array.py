"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of text."""

from __future__ import annotations

import numpy as np

def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. t ends with a unique smallest symbol."""
    n = len(t)
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    inner = at < n
    out[:-1][inner] = step[at[inner]] > 0
    return out


def _deal(items: np.ndarray, keys: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append items to the lists of their keys, in order."""
    if not len(items):
        return
    order = np.argsort(keys, kind="stable")
    items, keys = items[order], keys[order]
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    start = 0
    for end in [*cuts.tolist(), len(keys)]:
        into[keys[start]].append(items[start:end])
        start = end


def _bucketwise(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Induce the order of all suffixes from the leftmost-smaller ones, a bucket (first symbol) at a time."""
    n, empty = len(t), np.zeros(0, np.int64)
    seeds: list[list] = [[] for _ in range(size)]
    _deal(lms, t[lms], seeds)
    waiting: list[list] = [[] for _ in range(size)]
    larger = [empty] * size
    for c in range(size):
        out = front = np.concatenate(waiting[c]) if waiting[c] else empty
        rounds = [out]
        while len(front):
            front = front[front > 0] - 1
            front = front[(t[front] == c) & ~small[front]]
            rounds.append(front)
        larger[c] = np.concatenate(rounds)
        src = np.concatenate([larger[c], *seeds[c]])
        src = src[src > 0] - 1
        src = src[~small[src] & (t[src] > c)]
        _deal(src, t[src], waiting)
    waiting = [[] for _ in range(size)]
    smaller = [empty] * size
    for c in range(size - 1, 0, -1):
        front = np.concatenate(waiting[c]) if waiting[c] else empty
        rounds = [front]
        while len(front):
            front = front[front > 0] - 1
            front = front[(t[front] == c) & small[front]]
            rounds.append(front)
        smaller[c] = np.concatenate(rounds)
        src = np.concatenate([smaller[c], larger[c][::-1]])
        src = src[src > 0] - 1
        src = src[small[src] & (t[src] < c)]
        _deal(src, t[src], waiting)
    smaller[0] = np.array([n - 1])
    return np.concatenate([x for c in range(size) for x in (larger[c], smaller[c][::-1])])


def _ranks(names: np.ndarray, kinds: int, most: int | None) -> np.ndarray:
    """Order of the suffixes of a string of names: pairs of neighbours are named anew, each time twice as long, until all names differ
    or they cover `most` of the first names."""
    n, width = len(names), 1
    order = np.argsort(names, kind="stable")
    while kinds < n and (most is None or width < most):
        after = np.zeros(n, np.int64)
        after[: n - width] = names[width:] + 1
        key = names * (kinds + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        names = np.empty(n, np.int64)
        names[order] = new
        kinds, width = int(new[-1]) + 1, 2 * width
    return order


def suffix_array(t: np.ndarray, size: int, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of t, whose symbols are below `size` and whose last symbol, 0, stands there alone; with `depth` by their
    first so many symbols at least.

    Leftmost-smaller substrings are sorted by one induction and named; the string of their names, half as long at most, is
    sorted by doubling; a second induction from their order gives that of all suffixes, in linear time.
    """
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    small = suffix_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        sa = _bucketwise(t, small, lms, size)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms), 0) + 1
        a, b, m = ordered[1:], ordered[:-1], length[ordered[1:]]
        new = length[a] != length[b]
        same = np.flatnonzero(~new)
        if len(same):
            m = m[same]
            offs = np.concatenate([[0], np.cumsum(m)])
            j = np.arange(offs[-1]) - np.repeat(offs[:-1], m)
            new[same] = np.add.reduceat(t[np.repeat(a[same], m) + j] != t[np.repeat(b[same], m) + j], offs[:-1]) > 0
        name = np.empty(n, np.int64)
        name[ordered] = np.concatenate([[0], np.cumsum(new)])
        lms = lms[_ranks(name[lms], int(new.sum()) + 1, None if depth is None else depth // 2 + 2)]  # a name covers two symbols at least
    return _bucketwise(t, small, lms, size)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes of the bytes t: for each place in the text, how many symbols its suffix shares with the one
    ranked before it, `most` at most.

    Computed in text order over the permuted table of predecessors, eight bytes at a time, as far as the prefixes agree.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = t
    eight = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (n + most + 8, 8), (1, 1))).view(np.uint64).ravel()
    out, live = np.zeros(n, np.int64), np.sort(sa[1:])
    for j in range(0, most, 8):
        differ = eight[live + j] ^ eight[before[live] + j]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs: little-endian, so the first byte
        out[live] += np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
        live = live[differ == 0]
    room = n - np.maximum(np.arange(n), before)  # padding is no symbol
    room[sa[0]] = 0
    return np.minimum(np.minimum(out, room), most)
