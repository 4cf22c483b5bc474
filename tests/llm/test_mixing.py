import math
import re
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Reshare the excess by weight, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * unit > cap * sizes[s]}
        if not over:
            return target | {s: w[s] * unit for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def sizes_of(rows):
    out = {}
    for _, text, source in rows:
        out[source] = out.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size int, target string")
    got = mixing.mix(docs, **options).collect()
    sizes = sizes_of(rows)
    want = plain_targets(sizes)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    return got


CASES = [
    [(k, "w " * (k % 40), f"s{k % 7}") for k in range(300)],
    [(k, "w " * (1 + k % 9), "hot" if k % 3 else f"s{k}") for k in range(120)],
    [(1, None, None), (None, "a b", "x"), (None, "a b", "x"), (2, "", "y"), (3, "a " * 5000, "Z"), (4, "q", "é"), (5, "r r", "")],
    [(1, "only one", "s")],
    [(1, None, "a"), (2, "", None)],
    [(k, "w " * (1000 if k == 0 else 1), "big" if k == 0 else f"t{k}") for k in range(30)],
]


@pytest.mark.parametrize("rows", CASES)
@pytest.mark.parametrize("buckets", [1, 16, 1024])
def test_mix(spark, rows, buckets):
    check(spark, rows, buckets=buckets)


def test_epochs_come_first_and_the_rest_is_in_key_order(spark):
    rows = [(k, "w " * (5 + k % 30), f"s{k % 3}") for k in range(200)]
    for s in ("s0", "s1", "s2"):
        got = sorted((r for r in check(spark, rows) if r["source"] == s), key=lambda r: r["sample_key"])
        epochs = math.floor(got[0]["target"] / got[0]["source_size"])
        more = [r["taken"] - epochs * r["size"] for r in got]
        assert all(m >= 0 for m in more)
        cut = [m not in (0, r["size"]) for m, r in zip(more, got)]
        full = [m == r["size"] for m, r in zip(more, got)]
        assert sum(cut) <= 1 and full == sorted(full, reverse=True)


def test_keys_are_weighted_exponentials(spark):
    docs = spark.createDataFrame([(7, "abcde fghij", "s"), (8, None, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["sample_key"] for r in mixing.mix(docs).collect()}
    u = lambda i: (int(md5(str(i).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    w = 1 / (1 + abs(math.log((11 / 2 - 1) / 6)))
    assert got[7] == pytest.approx(-math.log(u(7)) / w) and got[8] == pytest.approx(-math.log(u(8)) / 0.05)


def test_better_documents_come_first_more_often(spark):
    rows = [(k, "aaaaaa " * 10 if k % 2 else "a " * 10, "s") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = mixing.mix(docs).orderBy("sample_key").limit(400).collect()
    assert sum(r["doc_id"] % 2 for r in first) > 260


def test_reruns_and_partitions_agree(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 11), f"s{k % 4}") for k in range(200)], "doc_id long, text string, source string")
    runs = [sorted(tuple(r) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(k, "w " * 10, f"s{k % 2}", 20, k) for k in range(100)], "doc_id long, text string, source string, n_chars long, size int")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    n = {r["source"]: r["n"] for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["s0"] * 10 - 1000 * 5 / 7) <= 10 and abs(n["s1"] * 10 - 1000 * 2 / 7) <= 10
    assert mixing.repeated(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_oracle(spark, sf, duck, same):
    from plumbline.llm.queries import ORACLES, QUERIES

    same(QUERIES["op5_mix_sources"](spark, sf), duck, ORACLES["op5_mix_sources"])
