"""Series, windows, splits, ladder, comparisons: small tables with known answers, and properties against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import compare, forecast, metrics, series, splits, windows


def points(spark, lengths):
    rows = [(d, f"{d}__{v}", i, float((i * 7919 + len(v)) % 101)) for (d, v), n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "domain string, var_key string, i int, v double")


def test_points_number_every_row_once(spark):
    rows = [(f"s{k % 2}", 1 + (k * 37) % 50, k, float(k)) for k in range(300)]
    df = spark.createDataFrame(rows, "s string, t int, k int, x double")
    got = series.points(df, F.col("s"), F.lit("v"), F.col("x"), ["t", "k"], F.floor(F.col("t") / 7)).collect()
    for s in ("s0", "s1"):
        want = [x for _, _, _, x in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))]
        assert [r["v"] for r in sorted((r for r in got if r["domain"] == s), key=lambda r: r["i"])] == want


@pytest.mark.parametrize("stride,chunk", [(1, 120), (4, 120), (7, 200), (12, 2048)])
def test_windows_by_chunks_and_frames_agree(spark, stride, chunk):
    pts = points(spark, {("a", "x"): 400, ("a", "y"): 107, ("b", "z"): 108})
    got = {r["sample_id"]: (r["past"], r["target"]) for r in windows.cut(pts, stride, chunk=chunk).collect()}
    want = {r["sample_id"]: (r["past"], r["target"]) for r in windows.cut_frames(pts, stride).collect()}
    assert got == want and "b__z__0" in got and not any(k.startswith("a__y") for k in got)
    assert all(len(p) == 96 and len(t) == 12 for p, t in got.values())
    assert sum(k.startswith("a__x") for k in got) == len(range(0, 400 - 107, stride))


def test_cut_at_leaves_short_windows_out(spark):
    pts = points(spark, {("a", "x"): 300})
    starts = spark.createDataFrame([("a__x", 0), ("a__x", 192), ("a__x", 193), ("a__q", 0)], "var_key string, s int")
    assert sorted(r["s"] for r in windows.cut_at(pts, starts, chunk=120).collect()) == [0, 192]


def test_splits_do_not_leak(spark):
    pts = points(spark, {("a", "x"): 1000, ("a", "y"): 1200})
    got = splits.native(series.lengths(pts), 4).collect()
    t1, t2 = 700, 800
    for r in got:
        first, last = r["s"] + 96, r["s"] + 108
        assert {"train": last <= t1, "val": first >= t1 and last <= t2, "test": first >= t2}[r["split"]]
    per = [r for r in got if r["var_key"] == "a__x" and r["split"] == "val"]
    assert [r["pos"] for r in sorted(per, key=lambda r: r["s"])] == list(range(len(per)))


def test_sample_id_suffix(spark):
    rows = [("d", "v", 0, 5, "2024-01-01T00:00:00"), ("d", "v", 1, None, "2024-01-01T00:00:00"), ("d", "v", 2, 9, "2024-01-01T00:00:00"), ("d", "w", 3, 1, "2024-01-01T00:00:00")]
    df = spark.createDataFrame(rows, "domain string, var string, file_pos int, idx int, t string").withColumn("future_start", F.col("t").cast("timestamp_ntz"))
    got = {r["file_pos"]: r["sample_id"] for r in splits.sample_ids(df).collect()}
    base = "d__v__20240101T000000"
    assert got == {0: base, 1: f"{base}__iNone", 2: f"{base}__i9", 3: "d__w__20240101T000000"}


def test_ladder_weighs_groups_equally(spark):
    rows = [("M", 1, "p", f"p__{k}", "w", float(x)) for k, x in enumerate((1, 3))] + [("M", 1, "q", "q__0", "w", 10.0)]
    scored = spark.createDataFrame(rows, "method string, seed int, domain string, var_key string, sample_id string, mse double")
    for m in metrics.METRICS[1:]:
        scored = scored.withColumn(m, F.col("mse"))
    total = metrics.overall_level(metrics.domain_level(metrics.variable_level(scored)))
    assert total.first()["mse"] == 6.0
    assert metrics.over_seeds(total).first()["mse_std"] is None
    three = total.select("method", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seed"), *[F.col(m) for m in metrics.METRICS], "n_domains").withColumn("mse", F.col("seed").cast("double"))
    r = metrics.over_seeds(three).first()
    assert (r["mse_mean"], r["mse_std"], r["n_seeds"]) == (2.0, 1.0, 3)


def test_fallback_needs_every_domain(spark):
    by_domain = spark.createDataFrame([("R", 0, "a", 1.0, 1.0), ("R", 0, "b", 3.0, 3.0), ("S", 1, "a", 5.0, 5.0)], "method string, seed int, domain string, mse double, mae double")
    sel = spark.createDataFrame([("S", 1, "a", False), ("S", 1, "b", True)], "method string, seed int, domain string, fallback boolean")
    r = compare.with_fallback(by_domain, sel, "R").first()
    assert (r["overall_mse"], r["n_fallback"], r["n_domains"]) == (4.0, 1, 2)
    gap = spark.createDataFrame([("S", 1, "a", False), ("S", 1, "b", False)], sel.schema)
    assert compare.with_fallback(by_domain, gap, "R").first()["overall_mse"] is None


def test_improvements_and_comparisons(spark):
    level = spark.createDataFrame([("R", 0, "a", 1.0, 1.0), ("R", 0, "b", 2.0, 0.0), ("S", 1, "a", 0.5, 1.0), ("S", 2, "a", 0.9, 1.0), ("S", 1, "b", 3.0, 0.0), ("S", 2, "b", 3.0, 0.0)], "method string, seed int, k string, mse double, mae double")
    got = {r["metric"]: tuple(r[c] for c in ("improved", "degraded", "equal", "total")) for r in compare.improvement_counts(level, "k", "R").collect()}
    assert got == {"mse": (1, 1, 0, 2), "mae": (0, 0, 2, 2)}
    zero = spark.createDataFrame([("R", 0, 2.0, 0.0), ("S", 1, 3.0, 1.0)], "method string, seed int, mse double, mae double")
    got = {r["metric"]: (r["delta"], r["relative_improvement"]) for r in compare.comparisons(zero, [("S", "R")]).collect()}
    assert got == {"mse": (1.0, -50.0), "mae": (1.0, None)}


def test_best_epoch_ties_go_to_the_earlier(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.0), ("r", 3, 1.0), ("r", 4, math.nan), ("q", 1, math.nan), ("q", 2, 5.0)], "run string, epoch int, val_mse double")
    assert {r["run"]: r["epoch"] for r in compare.best_epoch(df).collect()} == {"r": 2, "q": 2}
    assert {r["run"]: r["epoch"] for r in compare.best_epoch(df, tolerance=1.0).collect()} == {"r": 1, "q": 2}


def test_diff_sees_one_sided_and_far_cells(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, x double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 3.0)], "k int, x double")
    r = compare.diff(a, b, ["k"], ["x"], atol=0.1).first()
    assert (r["cells"], r["one_sided"], r["beyond"], r["max_abs"], r["max_rel"]) == (4, 2, 1, 0.5, 0.25)


def test_model_hook_is_batch_free_and_seeded(spark):
    def load():
        return lambda past, seed: np.random.default_rng(seed).normal(past[-1], 1, (100, 12)).astype(np.float32)

    w = windows.cut(points(spark, {("a", "x"): 130}), 4)
    runs = [{(r["sample_id"], r["seed"]): r["pred"] for r in forecast.with_model(w.repartition(n), load, (1, 2), "U").collect()} for n in (1, 5)]
    assert runs[0] == runs[1] and len({tuple(p) for p in runs[0].values()}) == len(runs[0])
    assert all(len(p) == 12 for p in runs[0].values())


def test_nested_draw_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "x array<array<float>>")
    assert df.select(forecast.nested_draw_mean(F.col("x")).alias("m")).first()["m"] == [2.0, 4.0]


def test_frequency_mask_keeps_mean_and_reruns_agree(spark):
    w = windows.cut(points(spark, {("a", "x"): 300}), 4)
    a, b = ({r["sample_id"]: r["past"] + r["target"] for r in forecast.frequency_mask(w, 5).collect()} for _ in range(2))
    plain = {r["sample_id"]: r["past"] + r["target"] for r in w.collect()}
    assert a == b and 0 < sum(a[k] != plain[k] for k in a) < len(a)
    assert all(abs(np.mean(a[k]) - np.mean(plain[k])) < 1e-9 and len(a[k]) == 108 for k in a)


def test_balanced_draws_are_even(spark):
    s = splits.native(series.lengths(points(spark, {("a", "x"): 500, ("a", "y"): 200})), 4)
    got = splits.balanced_draws(s, 10, 1).collect()
    assert sorted({(r["var_key"], sum(q["var_key"] == r["var_key"] for q in got)) for r in got}) == [("a__x", 10), ("a__y", 10)]


def test_dense_is_every_training_start(spark):
    lens = series.lengths(points(spark, {("a", "x"): 400}))
    assert splits.dense(lens).count() == 280 - 108 + 1
