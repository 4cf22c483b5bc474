"""Toxicity learns from every labelled row, however many and long they are."""

import numpy as np

from plumbline.llm import toxicity as tox


def table(spark, n=720):
    bad = [f"vile{k} scum" for k in range(6)]
    rows = [(i, f"some day {i % 37} was fine and {bad[i % 6] if i % 4 == 0 else 'quiet'} it went {i % 11}", "en" if i % 2 else "de") for i in range(n)]
    docs = spark.createDataFrame([*rows, (n, "long " * 6000, "en")], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)] + [(n, 0)], "doc_id long, toxic int")


def test_long_texts_are_learned_from(spark):
    docs, labels = table(spark, 40)
    rows = tox.training_rows(docs, labels, ~tox.held_out(docs["doc_id"], 3, 9))
    assert rows.count() == 41


def test_many_workers_learn_from_all_rows(spark):
    docs, labels = table(spark)
    got = {r["doc_id"]: r for r in tox.score_toxicity(docs, labels, share=120).collect()}
    again = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs.repartition(5), labels, share=120).collect()}
    assert len(got) == 721 and all(abs(r["score"] - again[i]) < 1e-6 for i, r in got.items())
    for out in (False, True):
        y = np.array([i % 4 == 0 and i < 720 for i, r in got.items() if r["held_out"] == out])
        p = np.array([r["score"] >= 0.7 for r in got.values() if r["held_out"] == out])
        assert (p == y).mean() > 0.98
    assert {r["threshold"] for r in got.values()} and all(0 < r["threshold"] < 1 for r in got.values())


def test_first_model_is_one_row_however_often_rows_are_dealt(spark, monkeypatch):
    """Counts given with a key may be raised, and joins broadcast or not: one first worker, and the same scores."""
    from pyspark.sql.classic.dataframe import DataFrame

    docs, labels = table(spark)
    want = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, labels, share=120).collect()}
    plain, collect, most = DataFrame.repartition, DataFrame.collect, []

    def collected(d):
        got = collect(d)
        most.append(len(got) if d.columns == ["model"] else 0)
        return got

    monkeypatch.setattr(DataFrame, "repartition", lambda d, n, *c: plain(d, max(n, 23) if c else n, *c))
    monkeypatch.setattr(DataFrame, "collect", collected)
    again = {r["doc_id"]: r["score"] for r in tox.score_toxicity(docs, labels, share=120).collect()}
    assert max(most) == 1 and again == want
