"""Suffix arrays and common prefixes in numpy, for a string made of parts that no match may cross.

A string is an array of units (bytes or word numbers); ``end[i]`` is where the part of position i ends, and ``part[i]`` its number. The end
of a part sorts before every unit, and ends of different parts by their number, so all suffixes differ.
"""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray, h: int, end: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) by Larsson-Sadakane refinement.

    ``keys`` order the suffixes by their first ``h`` units, ended ones first. A round sorts only suffixes whose first h units are not
    theirs alone, by the rank of what follows, and so doubles h.
    """
    n = len(keys)
    sa = np.argsort(keys, kind="stable")
    rank, parts = np.empty(n, dtype=np.int64), int(part.max()) + 1 if n else 0

    def heads(at: np.ndarray, sorted_keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Ranks the suffixes ``at`` by the first slot of their group; returns the slots of groups of two or more."""
        new = np.ones(len(at) + 1, dtype=bool)
        np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:-1])
        rank[at] = slots[np.maximum.accumulate(np.where(new[:-1], np.arange(len(at)), 0))]
        return slots[~(new[:-1] & new[1:])]

    slots = heads(sa, keys[sa], np.arange(n)) if n else sa
    while len(slots):
        at = sa[slots]
        follow = at + h
        second = np.where(follow < end[at], rank[np.minimum(follow, n - 1)] + parts, part[at])
        key = rank[at] << 32 | second
        order = np.argsort(key)
        at = at[order]
        sa[slots] = at
        slots = heads(at, key[order], slots)
        h *= 2
    return sa, rank


def words_of(units: np.ndarray) -> tuple[np.ndarray, int]:
    """The eight bytes from each position on as one number, and the bits of a unit (8 or 32)."""
    size = units.dtype.itemsize
    padded = np.concatenate((units, np.zeros(8 // size, dtype=units.dtype)))
    return np.ascontiguousarray(np.ndarray((len(units),), dtype="<u8", buffer=padded.tobytes(), strides=(size,))), 8 * size


def common_prefixes(sa: np.ndarray, units: np.ndarray, end: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, other): for each position, the units that its suffix shares with the one before it in order, and that suffix (-1: none).

    Kasai's rule: where both suffixes are preceded by the same unit, the length is the last position's less one. So only the others
    are compared, all at once, eight bytes a step.
    """
    n = len(sa)
    other = np.full(n, -1, dtype=np.int64)
    other[sa[1:]] = sa[:-1]
    if not n:
        return other, other
    first = np.ones(n, dtype=bool)
    np.not_equal(part[1:], part[:-1], out=first[1:])
    before = np.concatenate((units[:1], units[:-1]))
    known = (other >= 0) & ~first & ~first[other] & (before == before[other])
    length = np.zeros(n, dtype=np.int64)
    words, bits = words_of(units)
    a = np.flatnonzero(~known & (other >= 0))
    b = other[a]
    most, got, open_ = np.minimum(end[a] - a, end[b] - b), np.zeros(len(a), dtype=np.int64), np.arange(len(a))
    while len(open_):
        x = words[a[open_] + got[open_]] ^ words[b[open_] + got[open_]]
        got[open_] += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // bits
        open_ = open_[(x == 0) & (got[open_] < most[open_])]
    length[a] = np.minimum(got, most)
    last = np.maximum.accumulate(np.where(known, 0, np.arange(n)))
    return length[last] - (np.arange(n) - last), other


class Extensions:
    """Longest common extensions of two positions in constant time: least common prefixes over ranges of the suffix array."""

    def __init__(self, units: np.ndarray, end: np.ndarray, part: np.ndarray):
        self.n, self.end = len(units), end
        self.sa, self.rank = suffix_array(units.astype(np.int64), 1, end, part)
        length, _ = common_prefixes(self.sa, units, end, part)
        self.table = [length[self.sa].astype(np.int32)]  # [k][r]: least of 2**k lengths from rank r on
        while 2 << (len(self.table) - 1) <= self.n:
            t, w = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-w], t[w:]))
        self.flat = np.concatenate(self.table) if self.n else np.zeros(0, dtype=np.int32)
        self.at = np.concatenate(([0], np.cumsum([len(t) for t in self.table])[:-1])).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common units from a and b on, a <> b; 0 where either lies outside."""
        out = np.zeros(len(a), dtype=np.int64)
        ok = np.flatnonzero((a >= 0) & (b >= 0) & (a < self.n) & (b < self.n))
        x, y = self.rank[a[ok]], self.rank[b[ok]]
        lo, hi = np.minimum(x, y) + 1, np.maximum(x, y)
        k = np.frexp((hi - lo + 1).astype(np.float64))[1].astype(np.int64) - 1
        out[ok] = np.minimum(self.flat[self.at[k] + lo], self.flat[self.at[k] + hi - (1 << k) + 1])
        return out

    def interval(self, a: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi): ranks of all suffixes that begin with the ``length`` units from a on, the place of that string in the suffix tree."""
        lo, hi = self.rank[a].copy(), self.rank[a] + 1
        for k in range(len(self.table) - 1, -1, -1):
            t, w = self.table[k], 1 << k
            # suffixes lo-w .. lo-1 share it if the lengths at ranks lo-w+1 .. lo allow it
            can = lo - w >= 0
            can[can] = t[lo[can] - w + 1] >= length[can]
            lo[can] -= w
            can = hi + w <= self.n
            can[can] = t[hi[can]] >= length[can]
            hi[can] += w
        return lo, hi
