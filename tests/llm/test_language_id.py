import itertools
import zlib

import numpy as np
import pytest

from plumbline.llm import language_id as lid


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    lengths = np.array([5, 3, 1])
    emit = rng.uniform(0.01, 1, (5, 3, 3))
    trans, prior = rng.uniform(0.1, 1, (3, 3)), rng.uniform(0.1, 1, 3)
    got = lid.forward_backward(emit, lengths, trans, prior)[0]
    for c, n in enumerate(lengths):
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = prior[path[0]] * np.prod([emit[t, c, k] for t, k in enumerate(path)]) * np.prod([trans[a, b] for a, b in zip(path, path[1:])])
            for t, k in enumerate(path):
                want[t, k] += p
        np.testing.assert_allclose(got[:n, c], want / want.sum(1, keepdims=True), atol=1e-12)
        assert not got[n:, c].any()


@pytest.fixture(scope="module")
def model(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    t["out"] = [zlib.crc32(str(i).encode()) % 4 == 2 for i in t.doc_id]
    return lid.fit(list(zip(t.text[~t.out], t.lang[~t.out]))), t[t.out]


def test_held_out_accuracy(model):
    crf, held = model
    got = [x for x, _ in lid.Tagger(crf).label(held.text.tolist())]
    assert np.mean(np.array(got) == held.lang.to_numpy()) >= 0.93


def test_words_of_switched_text(model):
    crf, held = model
    texts = {lang: lid.words_of(held.text[held.lang == lang].iloc[0])[:40] for lang in ("en", "de")}
    tagged = lid.Tagger(crf).words(" ".join(texts["en"] + texts["de"]))
    first, second = tagged[: len(texts["en"])], tagged[len(texts["en"]) :]
    assert np.mean([x == "en" for _, x, _ in first]) > 0.9 and np.mean([x == "de" for _, x, _ in second]) > 0.9
    assert np.all(np.diag(crf.trans) > crf.trans.max() - 5) and (np.diag(crf.trans) == crf.trans.max(1)).all()  # it learned to stay


def test_batches_do_not_matter(model):
    crf, held = model
    texts = [*held.text.tolist()[:20], "", None, "123", "ß " * 20_000, "的", "a"]
    one = [lid.Tagger(crf).label([t])[0] for t in texts]
    together = lid.Tagger(crf).label(texts)
    assert [x for x, _ in one] == [x for x, _ in together]
    np.testing.assert_allclose([s for _, s in one], [s for _, s in together], atol=1e-9)
    assert together[20] == together[21] == together[22] == ("und", 0.0)


def test_odd_tables(spark, sf):
    docs = spark.createDataFrame([(1, "the the", "en", 1), (2, "und und", "de", 1), (None, "the", None, 1), (1, None, "en", 1), (3, " 12 ?", None, 1), (4, "und", "fr", 1)] + [(k, "the of", "en", 1) for k in range(5, 40)], "doc_id long, text string, lang string, score int")
    got = lid.identify(docs).collect()
    assert len(got) == 41 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["lang_pred"] for r in got if r["doc_id"] == 3] == ["und"]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
    unlabelled = docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert {r["lang_pred"] for r in lid.identify(unlabelled).collect()} == {"und"}
    assert lid.identify(docs.limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = [(k, "the of and" if k % 2 else "und der die", "en" if k % 2 else "de") for k in range(40)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    odd = plain.selectExpr("1 AS held_out", "2 AS lang_pred", "'x' AS score", "doc_id", "3 AS s_id", "text", "lang", "4 AS s_o", "5 AS o")
    assert sorted(lid.identify(odd).collect()) == sorted(lid.identify(plain).collect())


def test_whole_query_is_one_process(spark, sf):
    """Every row of the query against a fit and a labelling in this process, text by text."""
    import xxhash

    from plumbline.llm.queries import QUERIES

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    all_ = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    rows = [(t, lang) for i, t, lang in all_ if not out(i) and lang is not None and t is not None and len(t) <= 8000]  # all of them: fewer than the bound of a language
    crf = lid.fit(sorted(set(rows), key=lambda r: xxhash.xxh3_64_intdigest(r[0].encode(), 5)))
    tagger = lid.Tagger(crf)
    want = {i: tagger.label([t])[0] for i, t, _ in all_}
    got = {r["doc_id"]: (r["held_out"], r["lang_pred"], r["score"]) for r in QUERIES["op8_language_id"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == out(i) for i in got)
    same = [got[i][1] == want[i][0] for i in want]
    assert np.mean(same) == 1.0 and max(abs(got[i][2] - want[i][1]) for i in want) < 0.05


def test_long_runs_count_whole(model):
    crf, held = model
    en, de = ("".join(lid.words_of(" ".join(held.text[held.lang == lang]))) for lang in ("en", "de"))
    tagger = lid.Tagger(crf)
    assert tagger.label([en[:24] + de[:3000]])[0][0] == "de" and tagger.label([de[:24] + en[:3000]])[0][0] == "en"
    assert len(set(lid.features("a" * 10 + "abcdefghijklmnopqrstuvwxyz")) & {"xyz", "uvw"}) == 2


def test_pieces_hold_every_triple():
    for n in (1, 2, 63, 64, 65, 66, 67, 126, 127, 128, 500):
        w = "".join(chr(0x4E00 + k) for k in range(n))
        got = lid.pieces(w)
        triples = [p[k : k + 3] for p in got for k in range(len(p) - 2)]
        assert max(map(len, got)) <= lid.PIECE and set("".join(got)) == set(w) and triples == [w[k : k + 3] for k in range(n - 2)]


def test_all_of_a_text_without_words_counts(monkeypatch, model):
    crf, _ = model
    tagger, seen = lid.Tagger(crf), []
    numbers = tagger.numbers
    monkeypatch.setattr(tagger, "numbers", lambda words: seen.extend(words) or numbers(words))
    tagger.label(["一二 " * 100 + "三" * 100])
    assert seen.count("一二") == 100 and sum(x.count("三") for x in seen) >= 100
