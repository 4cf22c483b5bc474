"""Exact sums against fractions, the ladder's bits on other layouts, and merged moments against two passes."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exact, scalar
from plumbline.operators import metrics, series, windows


def numbers(seed, n=400):
    r = random.Random(seed)
    return [r.choice((1, -1)) * r.random() * 2.0 ** r.randint(-40, 90) for _ in range(n)] + [1e30, -1e30, 0.1, -0.0]


@pytest.mark.parametrize("seed", range(4))
def test_sum_is_exact_in_any_order(spark, seed):
    xs, got = numbers(seed), set()
    for n in (1, 3, 7):
        random.Random(n).shuffle(xs)
        f = spark.createDataFrame([(x,) for x in xs], "x double").repartition(n)
        got.add(f.agg(exact.exact_sum("x")).first()[0])
    want = float(sum(map(Fraction, xs)))
    assert len(got) == 1 and abs(got.pop() - want) <= 4 * math.ulp(want)


def test_small_differences_and_signs(spark):
    rows = [("a", 1e30), ("a", -1e30), ("a", -(2.0**-90)), ("b", 0.1), ("b", 0.2), ("b", -0.3), ("c", None), ("d", 3.0), ("d", None), ("e", -5.5), ("f", 2.0**-200), ("g", 2.0**111), ("g", 2.0**111)]
    f = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["s"], r["m"]) for r in f.groupBy("k").agg(exact.exact_sum("x").alias("s"), exact.exact_avg("x").alias("m")).collect()}
    exactly = float(Fraction(0.1) + Fraction(0.2) - Fraction(0.3))
    assert got == {"a": (-(2.0**-90), -(2.0**-90) / 3), "b": (exactly, exactly / 3), "c": (None, None), "d": (3.0, 3.0), "e": (-5.5, -5.5), "f": (0.0, 0.0), "g": (2.0**112, 2.0**111)}


def test_not_numbers(spark):
    inf, nan = math.inf, math.nan
    rows = [("nan", nan), ("nan", 1.0), ("inf", inf), ("inf", -1e300), ("inf", 2.0), ("both", inf), ("both", -inf), ("far", -(2.0**112)), ("far", 1.0)]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "k string, x double").groupBy("k").agg(exact.exact_sum("x")).collect()}
    assert math.isnan(got["nan"]) and math.isnan(got["both"]) and got["far"] == -inf and math.isnan(got["inf"])


def test_sample_std(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 7.0), ("c", None)], "k string, x double")
    got = {r[0]: r[1] for r in f.groupBy("k").agg(exact.sample_std("x")).collect()}
    assert abs(got["a"] - math.sqrt(7 / 3)) < 1e-15 and got["b"] is None and got["c"] is None


def scored(spark, n=900):
    r = random.Random(3)
    rows = [(m, s, f"d{v % 5}", f"d{v % 5}__v{v}", f"w{k}", *[r.expovariate(1) * 10.0 ** r.randint(-9, 9) for _ in range(4)]) for k in range(n) for m, s in (("N0", 0), ("S", 1), ("S", 2)) for v in (k % 17,)]
    return spark.createDataFrame(rows, "method string, seed int, domain string, var_key string, sample_id string, mse double, mae double, raw_mse double, raw_mae double")


def test_ladder_has_the_same_bits_on_1_7_and_64_partitions(spark):
    rows = scored(spark)
    got = {r["level"]: (r["cells"], r["unequal"]) for r in metrics.bit_equal(rows, (1, 7, 64)).collect()}
    assert got == {"variable": (17 * 3 * 4, 0), "domain": (5 * 3 * 4, 0), "overall": (3 * 4, 0)}


def test_plain_sums_would_differ(spark, monkeypatch):
    """The check can fail: with Spark's own mean some cell differs on some layout."""
    monkeypatch.setattr(metrics, "exact_avg", F.avg)
    assert sum(r["unequal"] for r in metrics.bit_equal(scored(spark, 3000), (1, 3, 7, 64)).collect()) > 0


def walk(spark, values, var="v"):
    return spark.createDataFrame([("d", f"d__{var}", i, v) for i, v in enumerate(values)], "domain string, var_key string, i int, v double")


@pytest.mark.parametrize("stride,context,horizon,chunk", [(1, 96, 12, 2048), (4, 96, 12, 108), (3, 10, 4, 16), (5, 7, 2, 9)])
def test_summaries_are_the_windows(spark, stride, context, horizon, chunk):
    r = random.Random(chunk)
    pts = walk(spark, [1e6 + r.gauss(0, 1) * 10.0 ** r.randint(-6, 3) for _ in range(500)])
    want = windows.cut(pts, stride, context, horizon).select("sample_id", "s", "target", F.element_at("past", -1).alias("last"), scalar.array_mean(F.col("past")).alias("mean"), scalar.array_pstd(F.col("past")).alias("std"))
    want = {r["sample_id"]: r for r in want.collect()}
    got = {r["sample_id"]: r for r in windows.summaries(pts, stride, context, horizon, chunk).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert (g["s"], g["target"], g["last"]) == (w["s"], w["target"], w["last"])
        assert math.isclose(g["mean"], w["mean"], rel_tol=1e-13) and math.isclose(g["std"], w["std"], rel_tol=1e-9, abs_tol=1e-9)


def test_summaries_near_the_threshold_and_with_gaps(spark):
    flat = walk(spark, [7e8] * 150 + [7e8 + 1e-6 * (i % 2) for i in range(150)], "flat")
    sd = {r["s"]: r["std"] for r in windows.summaries(flat, 1).collect()}
    assert sd[0] == 0.0 and sd[54] == 0.0 and sd[180] > 0
    fb = series.fallback_std(flat)
    assert windows.with_scale(windows.summaries(flat, 1), fb).where("s = 0").first()["d"] == 1.0
    holes = walk(spark, [float(i) if i not in (120, 200) else (None if i == 120 else math.nan) for i in range(330)], "holes")
    rows = {r["s"]: r for r in windows.summaries(holes, 1).collect()}
    for s, r in rows.items():
        hit = any(s <= k < s + 96 for k in (120, 200))
        assert math.isnan(r["std"]) == hit and math.isnan(r["mean"]) == hit
    assert rows[25]["last"] is None and rows[24]["target"][0] is None


def test_no_context_in_the_plan(spark, sf):
    from plumbline.plans.queries import QUERIES_OF_WINDOWS

    for q in QUERIES_OF_WINDOWS:
        plan = q(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "slice(" not in plan and "past" not in plan
