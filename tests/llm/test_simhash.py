"""Fingerprints and components against plain Python over all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import simhash
from plumbline.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "a", "One two", "a b c", "a b c d", "A b C d e", "x\x0by\x85z \xa0 w v u", "Ärger ÄRGER É é " * 30, "w " * 200_000, "same same same same same"])
def test_fingerprint(text):
    assert simhash.fingerprint(text and text.encode()) == plain_fingerprint(text)


def fixtures(seed, n=400):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n // 4)]
    out = set(base)
    while len(out) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(1, 9)):
            x ^= 1 << b
        out.add(x)
        if rng.random() < 0.1:
            base.append(x)
    return sorted(out)


@pytest.mark.parametrize("blocks,shard_rows,sample", [(5, 40, 1000), (5, 10_000, 50), (6, 30, 200), (4, 25, 1000), (1, 20, 400)])
def test_links_are_those_of_all_pairs(spark, blocks, shard_rows, sample):
    fps = fixtures(blocks * 7 + shard_rows)
    # a dense ball: all within a few bits of one point
    fps = sorted({*fps, *(fps[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(1, 64, 7))})
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), k) for k, f in enumerate(fps)], "fp long, node long")
    edges = simhash.link_edges(nodes, blocks=blocks, sample=sample, shard_rows=shard_rows)
    got = {r["vertex"]: r["component"] for r in components(edges).collect()}
    assert [got.get(k, k) for k in range(len(fps))] == plain_components(fps)


def test_vantage_join_prunes_but_loses_nothing():
    fps = np.array(fixtures(3, 1200), dtype=np.uint64)
    links = simhash.Links(len(fps))
    simhash.join_within(fps, np.arange(len(fps)), None, 4, links, leaf=400)
    assert links.find(np.arange(len(fps))).tolist() == plain_components([int(f) for f in fps])


def test_long_chain_components(spark):
    n = 300
    order = random.Random(1).sample(range(n), n)
    edges = spark.createDataFrame([(max(a, b), min(a, b)) for a, b in zip(order, order[1:])] + [(1000, 999)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in components(edges).collect()}
    assert all(got.get(k, k) == 0 for k in range(n)) and got[1000] == 999
    assert components(edges.limit(0)).count() == 0


def test_documents(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(5, text), (3, text.upper()), (9, text + " tail"), (2, "something else of its own kind"), (7, None), (8, ""), (8, ""), (None, text), (11, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    fps = {i: f"{plain_fingerprint(t):016x}" for i, t in rows}
    assert {k for k in got} == {(i, fps[i]) for i, _ in rows}
    assert got[5, fps[5]] == got[3, fps[3]] == got[9, fps[9]] == got[None, fps[None]] == 3
    assert got[7, fps[7]] == got[8, fps[8]] == 7 and fps[7] == "0" * 16
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == [2, 3, 7, 11]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark, sf):
    from plumbline.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    fps = [plain_fingerprint(t) for _, t in docs]
    want = {(docs[k][0], f"{fps[k]:016x}", docs[c][0]) for k, c in enumerate(plain_components(fps))}
    got = QUERIES["op2_simhash_near_dedup"](spark, sf).select("doc_id", "fingerprint", F.col("component_id")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(docs)


@pytest.mark.parametrize("leaf", [1, 3, 16])
def test_vantage_join_of_two_sides_ends(leaf):
    fps = np.array(fixtures(5, 300), dtype=np.uint64)
    rows = np.arange(len(fps))
    for cut in (1, 2, 40, 299):
        links, want = simhash.Links(len(fps)), simhash.Links(len(fps))
        simhash.join_within(fps, rows[:cut], rows[cut:], 4, links, leaf=leaf)
        simhash._near(fps, rows[:cut], rows[cut:], 4, want)
        assert links.find(rows).tolist() == want.find(rows).tolist()


def test_rows_without_an_id_link_others(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.select("doc_id", "fp"))
    rows = [(1, 0x00), (None, 0x0F), (2, 0xFF), (None, 0xFFFF00), (None, 0xFFFF01), (3, 0x7777 << 40), (9, 0x00)]
    docs = spark.createDataFrame(rows, "doc_id long, fp long")
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    want = sorted((i or 0, f"{f:016x}", None if f in (0xFFFF00, 0xFFFF01) else 3 if i == 3 else 1) for i, f in rows)
    assert got == want
