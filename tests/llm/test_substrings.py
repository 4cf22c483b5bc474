"""Repeated strings against counting every string of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import substrings
from plumbline.llm.common import materialize


def brute(rows, length):
    raw = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + length] for _, t in raw for p in range(len(t) - length + 1))
    out = []
    for i, t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for p in range(len(t)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in frame.collect()), key=repr)


def made(seed, n=60):
    """Texts of few words, with copies, near copies, shared passages, one word over and over, and letters of two bytes."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    vocab = [word() for _ in range(50)]
    passage = [" ".join(r.choice(vocab) for _ in range(r.randint(2, 20))) for _ in range(6)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.15:
            texts.append(r.choice(texts))
        elif texts and kind < 0.4:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        elif kind < 0.5:
            texts.append("la " * r.randint(1, 60))
        else:
            texts.append(" ".join(r.choice(passage) if r.random() < 0.1 else r.choice(vocab) for _ in range(r.randint(0, 60))))
    return texts


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard": 200}), (3, {"spread": 2, "shard": 100}), (4, {"spread": 1, "shard": 1})])
def test_against_all_strings(spark, seed, options):
    rows = [(i, t) for i, t in enumerate(made(seed))] + [(None, None), (None, "x" * 90), (7, ""), (8, "short"), (9, "\0" * 40 + "end"), (9, "\0" * 40 + "end")]
    docs = materialize(spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, k string"), "substr_test")
    assert result(substrings.remove_repeats(docs, 24, gram=4, **options)) == brute(rows, 24)


def test_blocks_and_long_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 50)
    monkeypatch.setattr(substrings, "BLOCK", 300)
    for raw in (b"ab" * 2000, "".join(made(5)).encode(), b"", b"x" * 24, b"x" * 23):
        lo, many, name, _, twice = substrings.pieces_of(raw, 24, 4)
        assert np.array_equal(np.repeat(lo, many) + np.concatenate([np.arange(m) for m in many.tolist()] or [[]]), np.arange(max(0, len(raw) - 23)))
        full = substrings.names_of(np.frombuffer(raw, dtype=np.uint8), 24, 4)[0] if len(raw) > 23 else np.zeros(0, dtype=np.uint64)
        assert len(twice) == len(lo) and (raw[:2] != b"ab" or twice.all())
        assert np.array_equal(np.repeat(name, many), full.view(np.int64))


def test_merge_needs_both_hashes():
    def run(*rows):
        return np.array(list(rows), dtype=substrings._RUN)

    c, at = substrings.merge_runs([run((1, 5, 10, 0, 1), (2, 1, 10, 1, 1), (3, 7, 10, 2, 0)), run((1, 6, 20, 0, 1), (2, 1, 20, 9, 1), (3, 7, 20, 4, 1))])
    assert sorted(zip(c.tolist(), at.tolist())) == [(10, 1), (20, 4), (20, 9)]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(docs).count() == 0


def test_query(spark, sf):
    from plumbline.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_substring_dedup"](spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)
    assert got == brute(rows, 400)
    assert sum(r[2] for r in got) > 0
