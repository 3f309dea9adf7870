"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one; substrings between leftmost smaller
places (LMS) are sorted by induction and named; the string of names is sorted by naming pairs, pairs of pairs
and so on (a recursion whose alphabet would be too large for buckets); the whole array is then induced from
the sorted LMS places. Induction goes bucket by bucket, and inside a bucket in waves: all places known so far give their
predecessors at once. Induction is linear apart from numpy's stable sorting of small integers; a long run of
one symbol or of one short period costs as many waves as it is long.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Whether each suffix of t (whose last symbol is a unique least one) is of type S."""
    n = len(t)
    up = np.zeros(n, bool)
    up[-1] = True
    if n > 1:
        up[:-1] = t[:-1] < t[1:]
        same = np.concatenate([t[:-1] == t[1:], [False]])
        nearest = np.where(same, n, np.arange(n))
        up = up[np.minimum.accumulate(nearest[::-1])[::-1]]
    return up


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from LMS places given in order within each bucket."""
    n, kinds = len(t), len(tops) - 1
    sa = np.full(n, -1, np.int64)
    # LMS places at the ends of their buckets, in the order given
    own = t[lms]
    order = np.argsort(own, kind="stable")
    count = np.bincount(own, minlength=kinds)
    first = np.cumsum(count) - count
    marks = lms[order]
    head = tops[:-1].copy()

    def put(places: np.ndarray, symbols: np.ndarray, forward: bool, edge: np.ndarray) -> None:
        """Appends places to the fronts (or the ends) of their symbols' buckets, keeping their order."""
        by = np.argsort(symbols, kind="stable")
        s = symbols[by]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.concatenate([start, [len(s)]]))
        rank = np.arange(len(s)) - np.repeat(start, size)
        which = s[start]
        if forward:
            sa[np.repeat(edge[which], size) + rank] = places[by]
            edge[which] += size
        else:
            sa[np.repeat(edge[which], size) - 1 - rank] = places[by]
            edge[which] -= size

    # type L, from the least bucket on
    for c in range(kinds):
        if tops[c] == tops[c + 1]:
            continue
        done = tops[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            j = wave[wave > 0] - 1
            j = j[~small[j]]
            if len(j):
                put(j, t[j], True, head)
        if count[c]:
            j = marks[first[c] : first[c] + count[c]]
            j = j[j > 0] - 1
            j = j[~small[j]]
            if len(j):
                put(j, t[j], True, head)
    # type S, from the greatest bucket down; LMS places are found anew
    tail = tops[1:].copy()
    for c in range(kinds - 1, -1, -1):
        if tops[c] == tops[c + 1]:
            continue
        done = tops[c + 1]
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1]
            done = tail[c]
            j = wave[wave > 0] - 1
            j = j[small[j]]
            if len(j):
                put(j, t[j], False, tail)
        if head[c] > tops[c]:
            wave = sa[tops[c] : head[c]][::-1]
            j = wave[wave > 0] - 1
            j = j[small[j]]
            if len(j):
                put(j, t[j], False, tail)
    sa[0] = n - 1  # the sentinel has no predecessor of type S before it in its bucket
    return sa


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The places of all suffixes of an array of small non-negative integers, in order (a shorter one first)."""
    t = np.concatenate([np.asarray(symbols).astype(np.int32) + 1, [0]]).astype(np.uint16 if len(symbols) == 0 or int(np.max(symbols)) < 65_000 else np.int32)
    return _sort(t)[1:]


def _sort(t: np.ndarray) -> np.ndarray:
    n = len(t)
    if n <= 2:
        return np.argsort(t, kind="stable")
    small = classify(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    tops = np.concatenate([[0], np.cumsum(np.bincount(t))])
    sa = induce(t, small, lms, tops)
    if len(lms) <= 1:
        return sa
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    names = _names(t, lms, ordered)
    return induce(t, small, lms[_sort_names(names)], tops)


def _sort_names(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names: names of pairs, of pairs of pairs and so on, until all differ.

    A name is the number of suffixes known to be smaller, so only places that share a name are named again.
    """
    order = np.argsort(names, kind="stable")
    of = names[order]
    new = np.concatenate([[True], of[1:] != of[:-1]])
    start = np.flatnonzero(new)
    rank = np.empty(len(names) + 1, np.int64)
    rank[order] = start[np.cumsum(new) - 1]
    rank[-1] = -1
    size = np.diff(np.concatenate([start, [len(of)]]))
    open_, step = order[np.repeat(size > 1, size)], 1
    while len(open_):
        key = rank[open_] << 32 | rank[np.minimum(open_ + step, len(names))] + 1
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], key[1:] >> 32 != key[:-1] >> 32])
        at = np.arange(len(key))
        first = np.maximum.accumulate(np.where(group, at, 0))
        same = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = (key >> 32) + same - first
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(key)]]))
        open_, step = open_[np.repeat(size > 1, size)], step * 2
    out = np.empty(len(names), np.int64)
    out[rank[:-1]] = np.arange(len(names))
    return out


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings in the order of their places; equal substrings have equal names."""
    n = len(t)
    follow = np.zeros(n, np.int64)
    follow[lms[:-1]] = lms[1:] - lms[:-1] + 1
    follow[lms[-1]] = 1
    size = follow[ordered]
    same = size[1:] == size[:-1]
    a, b = ordered[:-1], ordered[1:]
    open_ = np.flatnonzero(same)
    for k in range(int(size.max())):
        open_ = open_[size[open_] > k]
        if not len(open_):
            break
        differ = t[a[open_] + k] != t[b[open_] + k]
        same[open_[differ]] = False
        open_ = open_[~differ]
    rank = np.concatenate([[0], np.cumsum(~same)])
    by_place = np.zeros(n, np.int64)
    by_place[ordered] = rank
    return by_place[lms]


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, its predecessor in the suffix array (-1: none) and the length of their common prefix.

    Where the symbols before a place and before its predecessor are equal, the prefix is shorter by one than
    that of the place before; only the other (irreducible) places are compared, all at once, symbol by symbol.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    prefix = np.zeros(n, np.int64)
    reduced = np.zeros(n, bool)
    reduced[1:] = (phi[1:] > 0) & (t[:-1] == t[phi[1:] - 1])
    start = np.flatnonzero(~reduced & (phi >= 0))
    other, open_, length = phi[start], np.arange(len(start)), 0
    got = np.zeros(len(start), np.int64)
    while len(open_):
        room = n - np.maximum(start[open_], other[open_]) - length
        open_ = open_[room > 0]
        equal = t[start[open_] + length] == t[other[open_] + length]
        open_ = open_[equal]
        got[open_] += 1
        length += 1
    prefix[start] = got
    last = np.maximum.accumulate(np.where(reduced, 0, np.arange(n)))
    prefix = np.maximum(prefix[last] - (np.arange(n) - last), 0)
    prefix[phi < 0] = 0
    return phi, prefix
