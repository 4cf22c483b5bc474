"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import pytest

from plumbline.llm import search
from plumbline.llm.common import materialize

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    tf = [(i, c, sum(c.values())) for i, c in tf if c]
    n_docs, total = len(tf), sum(n for _, _, n in tf)
    df = Counter(t for _, c, _ in tf for t in c)
    wanted = {}
    for item, t in items:
        wanted.setdefault(item, set()).update(terms(t))
    out = []
    for item, ts in wanted.items():
        rows = []
        for i, c, n in tf:
            m = 100 - 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(rows)[:best])]
    return sorted(out, key=repr)


def got(frame):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in frame.collect()), key=repr)


def corpus(seed, n=300):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abÉéxyz09") for _ in range(r.randint(1, 4))) for _ in range(120)]
    docs = [(r.randrange(-50, 10 * n), r.choice((" ", "-", "\n")).join(r.choice(vocab[: r.randint(2, 120)]) for _ in range(r.randint(0, 40)))) for _ in range(n)]
    docs += [(None, None), (None, "A b É"), (5, ""), (6, "!?"), *[(77, "same text ab")] * 30, (1 << 40, " ".join(vocab * 300))]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 12)))) for i in range(12)] + [(3, "more xyz"), (None, "same"), (50, None), (51, "TEXT!")]
    return docs, items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"window": 16}), (3, {"window": 64, "most_postings": 50}), (4, {"block_bytes": 200})])
def test_against_all_pairs(spark, seed, options):
    docs, items = corpus(seed)
    d = materialize(spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, score string").repartition(5), "search_test")
    i = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    assert got(search.search(d, i, best=20, **options)) == brute(docs, items, 20)


def test_empty(spark):
    docs, items = corpus(5, 20)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        assert search.search(x, y).count() == 0


def test_query(spark, sf, duck, same):
    from plumbline.llm.queries import ORACLES, QUERIES

    same(QUERIES["op11_ranked_search"](spark, sf), duck, ORACLES["op11_ranked_search"])
    docs, items = (list(map(tuple, spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect())) for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got(QUERIES["op11_ranked_search"](spark, sf)) == brute(docs, items, 50)
