"""Runs against a check of every period at every place, and common extensions against plain comparison."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import runs
from plumbline.llm.suffix import Extensions, common_prefixes, suffix_array


def brute_runs(w, least=0, times=2):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((s, e, q) for (s, e), q in out.items())


def parts_of(texts):
    size = np.array([len(t) for t in texts])
    part = np.repeat(np.arange(len(texts)), size)
    return np.array([x for t in texts for x in t], dtype=np.int32), np.cumsum(size)[part], part


some_texts = st.lists(st.one_of(st.lists(st.integers(0, 2), min_size=1, max_size=30), st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 8)).map(lambda x: x[0] * x[1])), min_size=1, max_size=5)


@settings(max_examples=300, deadline=None)
@given(some_texts)
def test_suffixes_and_prefixes(texts):
    units, end, part = parts_of(texts)
    sa, rank = suffix_array(units.astype(np.int64), 1, end, part)
    want = sorted(range(len(units)), key=lambda i: [(1, x) for x in units[i : end[i]].tolist()] + [(0, int(part[i]))])
    assert sa.tolist() == want and rank[sa].tolist() == list(range(len(sa)))
    length, other = common_prefixes(sa, units, end, part)
    for i in range(len(units)):
        j, n = other[i], 0
        while j >= 0 and i + n < end[i] and j + n < end[j] and units[i + n] == units[j + n]:
            n += 1
        assert length[i] == n
    ext = Extensions(units, end, part)
    a, b = np.meshgrid(np.arange(len(units)), np.arange(len(units)))
    a, b = a[a != b], b[a != b]
    for i, j, got in zip(a.tolist(), b.tolist(), ext(a, b).tolist()):
        n = 0
        while i + n < end[i] and j + n < end[j] and units[i + n] == units[j + n]:
            n += 1
        assert got == n


@settings(max_examples=400, deadline=None)
@given(some_texts)
def test_all_runs(texts):
    units, end, part = parts_of(texts)
    at, want = 0, []
    for t in texts:
        want += [(s + at, e + at, q) for s, e, q in brute_runs(t)]
        at += len(t)
    assert sorted(map(tuple, runs.find_runs(units, end, part).tolist())) == sorted(want)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.lists(st.integers(0, 40), max_size=40), st.tuples(st.lists(st.integers(0, 9), max_size=9), st.lists(st.integers(0, 9), min_size=1, max_size=9), st.integers(1, 40)).map(lambda x: x[0] + (x[1] * x[2])[: x[2]] + x[0])), min_size=1, max_size=6))
def test_long_runs_of_texts(texts):
    ids, ends = np.array([x for t in texts for x in t], dtype=np.int64), np.cumsum([len(t) for t in texts])
    at, want = 0, []
    for t in texts:
        want += [(s + at, e + at, q) for s, e, q in brute_runs(t, 6, 4)]
        at += len(t)
    assert list(map(tuple, runs.long_runs(ids, ends).tolist())) == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_text_and_one_word():
    one = np.zeros(20_000, dtype=np.int64)
    assert runs.long_runs(one, np.array([20_000])).tolist() == [[0, 20_000, 1]]
    far = np.concatenate((np.arange(5000), np.tile(np.arange(5000, 9000), 5), np.arange(3)))
    assert runs.long_runs(far, np.array([len(far)])).tolist() == [[5000, 25_000, 4000]]


def brute(doc_id, text):
    """The query's row from the text, by the contract's words."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    rows = sorted(((s, e - s, q) for s, e, q in brute_runs(w, 6, 4)), key=lambda r: (r[0], r[2]))
    gone = {i for s, m, q in rows for i in range(s + q, s + m)}
    best = min(rows, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if rows else (None,) * 3
    milli = best[1] * 1000 // best[2] if rows else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in rows), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return doc_id, len(rows), *best, milli, *sha


def rows_of(frame):
    return sorted(map(tuple, frame.toArrow().to_pylist() and [tuple(r.values()) for r in frame.toArrow().to_pylist()]), key=repr)


def test_odd_rows(spark):
    odd = [(1, None, "x"), (2, "", "x"), (3, " \n\t ", "x"), (None, "a b a b a b a b a b", "x"), (None, None, None), (5, "la " * 50, "x"), (5, "la " * 50, "x"), (6, ("é ü\x0bñ " * 9) + "end", "x"), (11, "one two three " * 7 + "un deux " * 8, "x"), (13, "w" * 200_000, "x")]
    odd += [(i, " ".join(str(j * j % (i + 2)) for j in range(30 + i)), "y") for i in range(20, 80)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, n_runs string")
    assert rows_of(runs.detect(docs, plant=True)) == sorted((brute(i, t) for i, t, _ in odd), key=repr)
    assert runs.detect(docs.limit(0), plant=True).count() == 0
    plain = {r["doc_id"]: r for r in runs.detect(docs).collect()}
    assert plain[11]["n_runs"] == 2 and plain[11]["start"] == 21


def test_query(spark, sf):
    from plumbline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = rows_of(QUERIES["op13_periodic_runs"](spark, sf))
    short = {r["doc_id"] for r in docs if len((r["text"] or "").split()) < 1500}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert [r for r in got if r[0] in short] == sorted((brute(r["doc_id"], r["text"]) for r in docs if r["doc_id"] in short), key=repr)


@pytest.mark.parametrize("n", [0, 1, 7, 1000])
def test_planted(n):
    for i in range(60):
        how = runs.planted(n, i)
        assert (how is None) == (zlib.crc32(str(i).encode()) % 10 != 0 or n == 0)
