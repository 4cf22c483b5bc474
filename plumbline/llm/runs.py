"""Periodic runs of words, by Gusfield and Stoye's linear-time method for tandem repeats, over many texts at once.

Three steps on a batch of word numbers: (1) Lempel-Ziv blocks; common extensions at each block's borders give squares that cover the leftmost
occurrence of every kind of square. (2) Suffix-link walks: from each of them to its right-rotations, whose places in the suffix tree (ranges
of the suffix array) are marked once each; that completes the vocabulary. (3) Occurrences of the vocabulary are located in the tree, each
is extended to its run, and equal ones merge. All lookups are vectorised; only the block borders are followed one by one.

The method sees only stretches of a text that can hold a run of four periods: there every three words come back within a period, for
at least three periods less two words. That test is of a few array passes, loses no run, and leaves most prose out.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import ship, word_groups
from plumbline.llm.suffix import Extensions

LEAST, TIMES = 6, 4  # a run has at least LEAST words and TIMES periods
AT_ONCE = 1 << 20  # occurrences that are extended at a time
EMPTY = np.zeros((0, 3), dtype=np.int64)


def _blocks(ext: Extensions) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest that also starts before, overlaps included, or one unit."""
    n, sa = ext.n, ext.sa.tolist()
    up, down = [-1] * n, [-1] * n  # the nearest suffix in order, on either side, that starts before
    stack: list[int] = []
    for i in sa:
        while stack and stack[-1] > i:
            down[stack.pop()] = i
        if stack:
            up[i] = stack[-1]
        stack.append(i)
    at = np.arange(n)
    length = np.maximum(ext(at, np.array(up, dtype=np.int64)), ext(at, np.array(down, dtype=np.int64))).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += max(1, length[i])
    return np.array(starts, dtype=np.int64)


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, k) for k in 0..many[row]-1."""
    row = np.repeat(np.arange(len(many)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)


def _distinct(start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period), once each: equal stretches keep their least period."""
    o = np.lexsort((period, stop, start))
    rows = np.stack((start[o], stop[o], period[o]), axis=1)
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[keep]


def find_runs(units: np.ndarray, end: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Rows (start, stop, least period) of all runs of two or more periods in a string of parts, by start and stop."""
    n = len(units)
    if n < 2:
        return EMPTY
    units = units.astype(np.int32)
    forward = Extensions(units, end, part)
    first = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    back_part = int(part.max()) - part[::-1]
    begin = np.repeat(first, np.diff(np.append(first, n)))  # where each position's part begins
    backward = Extensions(units[::-1].copy(), n - begin[::-1], back_part)

    def grown(p: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch around p and p + period in which units a period apart are equal; it stays in a part."""
        same = padded[p] == padded[p + period], padded[p - 1] == padded[p + period - 1]
        return p - np.where(same[1], backward(n - p, n - p - period), 0), p + period + np.where(same[0], forward(p, p + period), 0)

    padded = np.append(part, -1)  # the place after the last unit, and that before the first, belong to no part
    starts = _blocks(forward)
    length = np.diff(np.append(starts, n))
    after = np.append(length[1:], 0)
    row, k = _spread(length)
    p1, k1 = (starts + length)[row] - k - 1, k + 1  # squares over the block's end, first half within the block
    row, k = _spread(length + after)
    p2, k2 = starts[row], k + 1  # squares over the block's start
    p, k = np.concatenate((p1, p2)), np.concatenate((k1, k2))
    ok = p + k <= n
    p, k = p[ok], k[ok]
    s, e = grown(p, k)
    ok = e - s >= 2 * k
    seeds = _distinct(s[ok], e[ok], k[ok])
    if not len(seeds):
        return EMPTY
    # The walks: a run's right-rotations, as far as they differ.
    row, t = _spread(np.minimum(seeds[:, 2], seeds[:, 1] - seeds[:, 0] - 2 * seeds[:, 2] + 1))
    p, k = seeds[row, 0] + t, seeds[row, 2]
    lo, hi = forward.interval(p, 2 * k)
    o = np.lexsort((k, lo))
    new = np.ones(len(o), dtype=bool)
    new[1:] = (lo[o][1:] != lo[o][:-1]) | (k[o][1:] != k[o][:-1])
    lo, hi, k = lo[o][new], hi[o][new], k[o][new]
    found, size = [seeds], np.cumsum(hi - lo)
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + AT_ONCE, side="right")))
        row, t = _spread((hi - lo)[a:b])
        p, q = forward.sa[lo[a:b][row] + t], k[a:b][row]
        s, e = grown(p, q)
        found.append(_distinct(s, e, q))
        a = b
    got = np.concatenate(found)
    return _distinct(got[:, 0], got[:, 1], got[:, 2])


def stretches(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows [a, b) of ``ids``, apart from each other, that hold all runs of LEAST words and TIMES periods; no stretch crosses one of ``ends``."""
    n = len(ids)
    if n < LEAST:
        return np.zeros((0, 2), dtype=np.int64)
    base = np.uint64(int(ids.max()) + 1)
    x = ids.astype(np.uint64)
    if int(base) < 1 << 21:
        grams = (x[:-2] * base + x[1:-1]) * base + x[2:]
    else:  # numbers of pairs first, so that three words fit
        pairs = np.unique(x[:-1] * base + x[1:], return_inverse=True)[1].astype(np.uint64)
        grams = pairs[:-1] * base + x[2:]
    doc = np.searchsorted(ends, np.arange(n), side="right")
    o = np.argsort(grams, kind="stable")
    gap = np.full(n, n + 1, dtype=np.int64)
    same = (grams[o][1:] == grams[o][:-1]) & (doc[o][1:] == doc[o][:-1])
    gap[o[:-1][same]] = (o[1:] - o[:-1])[same]
    cut = np.minimum(ends[doc] - np.arange(n), 3) < 3  # three words from here on leave the text
    gap[cut] = n + 1
    found, top = [], int(np.diff(np.concatenate(([0], ends))).max()) // TIMES
    seen = np.flatnonzero(gap <= n)  # in order; runs of neighbours among them are stretches
    reach = 1
    while True:
        at = seen[gap[seen] <= reach]
        least = reach // 2 + 1  # periods of this round: least .. reach
        need = max(LEAST, TIMES * least) - least - 2
        if len(at) >= need:
            new = np.flatnonzero(np.diff(at) != 1) + 1
            a, b = at[np.concatenate(([0], new))], at[np.concatenate((new - 1, [len(at) - 1]))] + 1
            long = b - a >= need
            found.append(np.stack((a[long], np.minimum(b[long] + reach + 2, ends[doc[a[long]]])), axis=1))
        if reach >= top:
            break
        reach *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    if not len(rows):
        return rows
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    far = np.maximum.accumulate(rows[:, 1])
    new = np.concatenate(([True], rows[1:, 0] >= far[:-1]))
    return np.stack((rows[new, 0], far[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)]), axis=1)


def long_runs(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, stop, period), by start and period, of all runs of LEAST words and TIMES periods in texts that stand one after another."""
    held = stretches(ids, ends)
    if not len(held):
        return EMPTY
    size = held[:, 1] - held[:, 0]
    row, t = _spread(size)
    place = held[row, 0] + t
    got = find_runs(np.unique(ids[place], return_inverse=True)[1], np.cumsum(size)[row], row)
    got = got[got[:, 1] - got[:, 0] >= np.maximum(LEAST, TIMES * got[:, 2])]
    length = got[:, 1] - got[:, 0]
    start = place[got[:, 0]] if len(got) else got[:, 0]
    rows = np.stack((start, start + length, got[:, 2]), axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def planted(n: int, doc_id: object) -> tuple[int, int] | None:
    """(a, p): from word a on, a text of n words repeats the p words from there; None for a text that stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def digest(words: list[bytes], ids: np.ndarray, runs: np.ndarray) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of a text's word numbers and its runs."""
    rows = [(s, e - s, q) for s, e, q in runs.tolist()]
    best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if rows else None
    gone = np.zeros(len(ids), dtype=bool)
    for s, m, q in rows:
        gone[s + q : s + m] = True
    kept = ids[~gone].tolist() if rows else ids.tolist()
    told = "".join(f"{s},{m},{q}\n" for s, m, q in rows).encode()
    text = b" ".join([words[i] for i in kept])
    return len(rows), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told).hexdigest(), hashlib.sha256(text).hexdigest()


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def detect(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of ``docs`` (doc_id, text): a narrow scan.

    Defined results: a null, empty or wordless text has no runs, four nulls and the hashes of nothing; rows are taken one by one, so repeated
    rows have equal results; an empty table gives an empty one; other columns are not read; a text of any length is taken whole, in one
    task. With ``plant``, the tails of some texts are made periodic first, by their id (none where it is null).
    """
    ship(docs.sparkSession)

    def scan(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            at = 0
            for words, ids, many in word_groups(b.column(1)):
                ids, own = ids.astype(np.int64), names[at : at + len(many)]
                ends = np.cumsum(many)
                for doc_id, n, e in zip(own, many.tolist(), ends.tolist()) if plant else ():
                    if how := planted(n, doc_id):
                        a, p = how
                        ids[e - n + a : e] = np.resize(ids[e - n + a : e - n + a + p], n - a)
                found = long_runs(ids, ends)
                cut = np.searchsorted(found[:, 0], np.concatenate(([0], ends)))
                rows = [digest(words, ids[e - n : e], found[x:y] - [e - n, e - n, 0]) for n, e, x, y in zip(many.tolist(), ends.tolist(), cut, cut[1:])]
                cols = [pa.array(c, pa.string() if k.endswith("256") else pa.int64()) for k, c in zip(NAMES, zip(*rows))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(many)), *cols], names=["doc_id", *NAMES])
                at += len(many)

    schema = docs.select("doc_id").schema
    for k in NAMES:
        schema = schema.add(k, "string" if k.endswith("256") else "long")
    return docs.select("doc_id", "text").mapInArrow(scan, schema)
