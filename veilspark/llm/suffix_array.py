"""Suffix arrays by induced sorting, vectorised over buckets of first symbols.

A suffix is S-type if it is smaller than the next one, else L-type; an S-type
suffix after an L-type one is leftmost-smaller (LMS). LMS substrings are put
in order by their symbols, named, and the string of names is sorted in turn;
from the order of the LMS suffixes the whole array is induced bucket by
bucket. A bucket's scan is done in rounds (what a round appends to its own
bucket is the next round), which gives the order of the sequential scan.

There are more names than a loop over buckets can afford. Over large alphabets
a suffix gets its place from its symbols up to the next LMS suffix and then from
that suffix's place, for all suffixes at once; where that would look at too many
symbols (long falling runs) they are induced entry by entry, into places counted
for each symbol.
"""

from __future__ import annotations

import numpy as np

#: Strings over larger alphabets are induced without a loop over buckets.
BUCKETS = 2048
#: Symbols up to the next LMS suffix, for each suffix on average, to go by them.
SYMBOLS_EACH = 8

_U = np.uint64


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type positions; the last symbol must be the only smallest."""
    n = len(t)
    nxt = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = t[nxt] < t[nxt + 1]
    return s


class _Deal:
    """Entries dealt to the buckets of their symbols, in order of arrival."""

    def __init__(self, t: np.ndarray, k: int):
        self.t, self.to = t, [[] for _ in range(k)]

    def add(self, p: np.ndarray) -> None:
        if len(p):
            c = self.t[p]
            order = np.argsort(c, kind="stable")
            p, c = p[order], c[order]
            at = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                self.to[c[lo]].append(p[lo:hi])

    def take(self, c: int) -> np.ndarray:
        return np.concatenate(self.to[c]) if self.to[c] else np.zeros(0, np.int64)


def _induce(t: np.ndarray, s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """Suffixes in order, given the LMS positions in their order per bucket."""
    seeds = _Deal(t, k)
    seeds.add(lms)
    pending, ltype = _Deal(t, k), []
    for c in range(k):
        cur, own = pending.take(c), []
        while len(cur):
            own.append(cur)
            p = cur[cur > 0] - 1
            p = p[~s[p]]
            same = t[p] == c
            pending.add(p[~same])
            cur = p[same]
        ltype.append(np.concatenate(own) if own else cur)
        p = seeds.take(c)
        p = p[p > 0] - 1
        pending.add(p[~s[p]])
    pending, whole = _Deal(t, k), [np.zeros(0, np.int64)] * k
    for c in range(k - 1, -1, -1):
        cur, own = pending.take(c), []
        while len(cur):
            own.append(cur)
            p = cur[cur > 0] - 1
            p = p[s[p]]
            same = t[p] == c
            pending.add(p[~same])
            cur = p[same]
        p = ltype[c][::-1]
        p = p[p > 0] - 1
        pending.add(p[s[p]])
        stype = np.concatenate(own)[::-1] if own else np.zeros(0, np.int64)
        if c == 0:
            stype = np.array([len(t) - 1])
        whole[c] = np.concatenate((ltype[c], stype))
    return np.concatenate(whole)


class PrefixHashes:
    """Hashes of the parts of a string, from sums over its prefixes."""

    def __init__(self, t: np.ndarray):
        base = 0x9E3779B97F4A7C15
        p, inv = np.full(len(t) + 1, base, _U), np.full(len(t) + 1, pow(base, -1, 1 << 64), _U)
        p[0] = inv[0] = 1
        p, self.inv = np.multiply.accumulate(p), np.multiply.accumulate(inv)
        self.c = np.zeros(len(t) + 1, _U)
        np.cumsum((t.astype(_U) + _U(1)) * _U(0xBF58476D1CE4E5B9) * p[:-1], out=self.c[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.c[end] - self.c[start]) * self.inv[start]


def _places(t: np.ndarray, s: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many of the substrings (``size`` symbols from ``start``) are before
    each, by symbols and, of equal symbols, L-type before S-type.

    As many symbols as fit into 62 bits are compared at a time; only
    substrings that are alike so far and longer are looked at again.
    """
    x = t.astype(np.int64) * 2 + s
    bits = int(x.max() + 1).bit_length()
    per = max(1, 62 // bits)
    place = np.zeros(len(start), np.int64)
    on, at = np.arange(len(start)), 0
    while len(on):
        key = np.zeros(len(on), np.int64)
        for j in range(at, at + per):
            inside = size[on] > j
            key = (key << bits) | np.where(inside, x[np.minimum(start[on] + j, len(t) - 1)] + 1, 0)
        order = np.lexsort((key, place[on])) if at else np.argsort(key)
        p, k = place[on][order], key[order]
        group = np.concatenate(([True], p[1:] != p[:-1]))
        part = group | np.concatenate(([True], k[1:] != k[:-1]))
        index = np.arange(len(on))
        base = np.maximum.accumulate(np.where(group, index, 0))
        first = np.maximum.accumulate(np.where(part, index, 0))
        place[on[order]] = p + first - base
        several = np.bincount(np.cumsum(part) - 1)[np.cumsum(part) - 1] > 1
        at += per
        on = on[order[several]]
        on = np.sort(on[size[on] > at])
    return place


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Name of each LMS substring (in text order): its place among the
    different ones."""
    return np.unique(_places(t, s, lms, np.append(lms[1:], len(t) - 1) - lms + 1), return_inverse=True)[1]


def _induce_counted(t: np.ndarray, s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """_induce() for any alphabet.

    Two suffixes with the same symbols and types up to the next LMS suffix
    (the last one alone has none) are in the order of these.
    """
    every = np.arange(len(t))
    place = np.full(len(t), -1, np.int64)
    place[lms] = np.arange(len(lms))
    at = np.flatnonzero(place >= 0)
    after = np.append(at[np.cumsum(place >= 0)[:-1]], len(t) - 1)
    size = after - every + 1
    if size.sum() > SYMBOLS_EACH * len(t):
        return _induce_scanned(t, s, k, lms)
    return np.argsort(_places(t, s, every, size) * len(lms) + place[after])


def _induce_scanned(t: np.ndarray, s: np.ndarray, k: int, lms: np.ndarray) -> np.ndarray:
    """_induce() entry by entry: one scan up, one down, over counted places."""
    sizes = np.bincount(t, minlength=k)
    ends = np.cumsum(sizes)
    symbols, stype, order = t.tolist(), s.tolist(), [0] * len(t)
    tails, heads = ends.tolist(), (ends - sizes).tolist()
    for p in lms[::-1].tolist():
        c = symbols[p]
        tails[c] -= 1
        order[tails[c]] = p
    for p in order:  # sees what it has put further on
        if p:
            p -= 1
            if not stype[p]:
                c = symbols[p]
                order[heads[c]] = p
                heads[c] += 1
    tails = ends.tolist()
    for p in reversed(order):
        if p:
            p -= 1
            if stype[p]:
                c = symbols[p]
                tails[c] -= 1
                order[tails[c]] = p
    return np.array(order, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``t`` in order.

    t: non-negative integers of which the last is the only smallest (0).
    """
    if len(t) < 3:
        return np.arange(len(t))[::-1].copy()
    k = int(t.max()) + 1
    induce = _induce_counted if k > BUCKETS else _induce
    if k <= BUCKETS:
        t = t.astype(np.uint16)  # sorted by digits
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    names = _names(t, s, lms)
    order = np.argsort(names) if names.max(initial=0) + 1 == len(lms) else suffix_array(names)
    return induce(t, s, k, lms[order])


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` (never the same) share,
    compared eight bytes at a time."""
    t = np.concatenate((t, np.zeros(8, t.dtype))).astype(np.uint16 if t.max(initial=0) < 1 << 16 else np.uint32)
    each = 8 // t.itemsize
    word = np.lib.stride_tricks.as_strided(t, (len(t) - each + 1, each), (t.itemsize,) * 2)
    word = np.ascontiguousarray(word).view(_U)[:, 0]
    got = np.zeros(len(a), np.int64)
    on = np.arange(len(a))
    while len(on):
        differ = word[a[on] + got[on]] ^ word[b[on] + got[on]]
        part = np.zeros(len(on), np.int64)
        for i in range(1, each):
            part += (differ & _U((1 << (8 * t.itemsize * i)) - 1)) == 0
        same = differ == 0
        got[on] += np.where(same, each, part)
        on = on[same]
    return got


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int | None = None) -> np.ndarray:
    """Permuted common prefixes: for each position the symbols (``most`` at
    most) that its suffix shares with the one before it in order.

    Where the symbols before both suffixes are the same too, the value is that
    of the position before less one; symbols are compared for the others only.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (before[1:] < 1) | (t[:-1] != t[before[1:] - 1])
    own = np.flatnonzero(fresh & (before >= 0))
    value = np.zeros(n, np.int64)
    value[own] = _shared(t, own, before[own])
    last = np.maximum.accumulate(np.where(fresh, at, 0))
    out = value[last] - (at - last)
    return out if most is None else np.minimum(out, most)


def full_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position whether its suffix shares ``most`` symbols with the
    one before it in order."""
    return common_prefixes(t, sa) >= most
