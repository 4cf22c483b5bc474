import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = []
    for i, t in items:
        w = plain_words(t)
        n = min(10, len(w))
        windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for i, t in docs:
        w, hit, owners = plain_words(t), set(), set()
        for name, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    owners.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, n_words int, spans string"), spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, items string")


def random_tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "c1", "é", "É", "d-d", "x"])
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 2, 9, 10, 11, 14])))) for k in range(8)]
    docs = [(k, " ".join(rng.choice([word(), rng.choice(items)[1]]) for _ in range(rng.randint(0, 25)))) for k in range(40)]
    return docs, [*items, (None, "q r s"), (3, None), (3, "uu vv ww")]


@pytest.mark.parametrize("seed,block_bytes", [(1, 1 << 20), (2, 60), (3, 25)])
def test_finds_what_plain_search_finds(spark, seed, block_bytes):
    docs, items = random_tables(seed)
    docs += [(None, None), (77, ""), (77, ""), (78, "q R\ns! " * 3), (79, "x " * 40_000 + "uu vv ww")]
    a, b = tables(spark, docs, items)
    got = sorted((tuple(r) for r in d.report(d.find_leaks(a, b, block_bytes=block_bytes)).collect()), key=repr)
    assert got == plain(docs, items)


def test_clean(spark):
    item = " ".join(f"t{k}" for k in range(12))
    keep = " ".join(f"k{k}" for k in range(60))
    docs = [(1, f"{keep}. {item.upper()}! {keep}"), (2, item), (None, f"{keep} {item}"), (3, keep), (3, keep), (4, None), (5, "")]
    a, b = tables(spark, docs, [(1, item)])
    a = a.withColumn("n_chars", F.length("text").cast("long"))
    got = d.clean(a, b)
    assert got.columns == a.columns
    rows = [(r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()]
    want = [(1, f"{keep}. ! {keep}"), (None, f"{keep} "), (3, keep), (3, keep), (4, None), (5, "")]
    assert sorted(rows, key=repr) == sorted(((i, t, None if t is None else len(t)) for i, t in want), key=repr)
    assert not d.find_leaks(got, b).where(F.size("spans") > 0).count()
    assert d.clean(a.limit(0), b).count() == 0 and d.clean(a, b.limit(0)).count() == 7


def test_oracle(spark, sf, duck, same):
    from plumbline.llm.queries import ORACLES, QUERIES

    same(QUERIES["op7_decontaminate"](spark, sf), duck, ORACLES["op7_decontaminate"])
