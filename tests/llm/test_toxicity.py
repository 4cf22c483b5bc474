import zlib

import numpy as np
import pytest

from plumbline.llm import toxicity as tox


def test_convolution_against_plain_loops():
    rng = np.random.default_rng(1)
    texts = [b"a b c d", b"", b"x", b"a x", b"c c c c c c c"]
    m = tox.ToxicityModel(np.unique([f for w in (b"a", b"b", b"c", b"x") for f in tox.features(w)]))
    m.shift, m.bias = rng.normal(0, 1, len(m.shift)).astype(np.float32), np.float32(0.3)
    got = tox.Scanner(m).scores(texts)
    for t, s in zip(texts, got):
        e = [*m.embed(tox.words_of(t)), np.zeros(tox.DIM)]
        act, k = [], 0
        for w_at, w in enumerate(tox.WIDTHS):
            # filters start at each word and at the empty place after them
            pad = [*e, *[np.zeros(tox.DIM)] * w]
            act += [max(sum(pad[i + j] @ m.conv[k + j][:, f] for j in range(w)) for i in range(len(e))) for f in range(tox.FILTERS)]
            k += w
        z = np.maximum(np.array(act) + m.shift, 0) @ m.out + m.bias
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_batches_do_not_matter():
    m = tox.ToxicityModel(np.unique([f for k in range(50) for f in tox.features(b"w%d" % k)]))
    rng = np.random.default_rng(2)
    texts = [b" ".join(b"w%d" % k for k in rng.integers(0, 60, n)) for n in (0, 1, 5, 400, 3)] + [None, b"!!"]
    np.testing.assert_allclose(tox.Scanner(m).scores(texts), [tox.Scanner(m).scores([t])[0] for t in texts], atol=1e-6)
    np.testing.assert_allclose(tox.Scanner(m).scores(texts, most=1), tox.Scanner(m).scores(texts), atol=1e-6)


@pytest.fixture(scope="module")
def table():
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    docs = pq.read_table(f"{folder}/documents.parquet").to_pandas().merge(pq.read_table(f"{folder}/labels.parquet").to_pandas(), on="doc_id")
    docs["out"] = [zlib.crc32(str(i).encode()) % 3 == 1 for i in docs.doc_id]
    return docs


def test_held_out(table):
    train = table[~table.out & (table.text.str.len() <= tox.MAX_CHARS)]
    m = tox.fit([(r.text, r.toxic, r.lang) for r in train.itertuples()])
    held = table[table.out]
    score = tox.Scanner(m).scores([t.encode() for t in held.text])
    y, p = held.toxic.to_numpy() == 1, score >= 0.7
    assert (p & y).sum() / y.sum() > 0.9 and (p & ~y).sum() <= 0.01 * (~y).sum()
    assert set(m.thresholds) == set(table.lang) and all(0 < t < 1 for t in m.thresholds.values())


def test_threshold():
    assert tox.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.55)
    assert tox.best_threshold(np.array([0.9, 0.1]), np.array([0, 0])) == tox.CUT
    assert tox.best_threshold(np.array([0.5, 0.5, 0.5]), np.array([1, 0, 0])) == 0.5


def test_clashing_columns(spark):
    rows = [(k, "you are scum" if k % 4 == 0 else f"a fine day {k}", "en") for k in range(60)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = plain.selectExpr("1 AS l_id", "2 AS y", "'x' AS o", "doc_id", "3 AS held_out", "text", "lang", "4 AS threshold", "5 AS s_id", "6 AS s_o")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0), 0) for k in range(60)], "doc_id long, quality int, toxic int, y int")
    assert sorted(tox.score_toxicity(odd, labels).collect()) == sorted(tox.score_toxicity(plain, labels).collect())


def test_whole_query_is_one_process(spark, sf):
    """Every row of the query against a fit and scores in this process, text by text."""
    import xxhash

    from plumbline.llm.queries import QUERIES

    docs = {r["doc_id"]: (r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    rows = {(t, label[i], lang, i) for i, (t, lang) in docs.items() if i in label and not out(i) and len(t) <= tox.MAX_CHARS}  # fewer than the bounds: all
    m = tox.fit([r[:3] for r in sorted(rows, key=lambda r: xxhash.xxh3_64_intdigest(r[0].encode(), 5))])
    scanner = tox.Scanner(m)
    got = {r["doc_id"]: r for r in QUERIES["op10_toxicity"](spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, (t, lang) in docs.items():
        s = float(scanner.scores([t.encode()])[0])
        assert got[i]["held_out"] == out(i) and abs(got[i]["score"] - s) < 0.02 and (got[i]["predicted"] == (s >= 0.7) or abs(s - 0.7) < 0.02)
        assert got[i]["flagged"] == (got[i]["score"] >= m.thresholds.get(lang, tox.CUT)) or abs(s - m.thresholds.get(lang, tox.CUT)) < 0.02


def test_odd_tables(spark):
    rows = [(k, "you are scum" if k % 4 == 0 else f"a fine day {k}", "en" if k % 2 else None, 0.5) for k in range(80)] + [(None, None, None, 0.1), (1, "", "en", 0.1), (1, "a " * 50_000, "xx", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)] + [(None, 1, 1), (3, 1, None), (5, 1, 7)], "doc_id long, quality int, toxic int")
    got = tox.score_toxicity(docs, labels).collect()
    assert len(got) == 83 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1)
    assert np.mean([r["score"] for r in got[:80] if r["doc_id"] is not None and r["doc_id"] % 4 == 0]) > 0.7
    assert not any(r["predicted"] for r in tox.score_toxicity(docs, labels.limit(0)).collect())
    assert tox.score_toxicity(docs.limit(0), labels).count() == 0
