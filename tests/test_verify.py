"""Two routes through the ladder, the archive's tolerance, and totals taken in passing."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import integrity, metrics, passing, report, verify

KIND = "method string, seed int, domain string, var_key string, sample_id string, pred array<double>, target array<double>, d double"


def preds(spark, n=40):
    rows = [(m, s, f"d{k % 3}", f"d{k % 3}__v{k % 7}", f"w{k}", [math.sin(k + h + s) for h in range(12)], [math.cos(k * h) for h in range(12)], 0.5 + k % 5) for k in range(n) for m, s in (("N0", 0), ("S", 1), ("S", 2))]
    return spark.createDataFrame(rows, KIND)


def test_routes_agree_and_faults_are_found(spark, tmp_path):
    p = preds(spark)
    scored = metrics.score(p)
    total = metrics.overall_level(metrics.domain_level(metrics.variable_level(scored)))
    archive = total.select("method", "seed", F.round("mse", 6).alias("MSE"), F.round("mae", 6).alias("MAE"))
    good = verify.verify(scored, p, archive)
    assert good.where("not ok").count() == 0 and good.agg(F.sum("cells")).first()[0] == 4 * 3 * (21 + 3 + 1) + 6
    assert report.write_evidence(good, f"file://{tmp_path}/ev") == {"ok": True, "n": 14}
    assert json.loads((tmp_path / "ev/two_routes.json").read_text())["ok"] is True
    # a fault in either side, of one cell
    for side in (0, 1):
        fault = p.withColumn("target", F.when(F.col("sample_id") == "w3", F.transform("target", lambda x: x + 1e-7)).otherwise(F.col("target")))
        bad = verify.verify(metrics.score(fault if side == 0 else p), fault if side == 1 else p)
        assert {r["item"] for r in bad.where("not ok").collect()} >= {"variable:mse", "domain:mae", "overall:raw_mse"}
    # a cell that one side lacks, and a value that is no number
    less = verify.agreement(metrics.ladder(scored).where("key <> 'd1__v1' or seed <> 2"), verify.long_ladder(p), "x").where("not ok").collect()
    assert {(r["item"], r["one_sided"], r["beyond"]) for r in less} == {(f"variable:{m}", 1, 1) for m in metrics.METRICS}
    nan = verify.agreement(metrics.ladder(scored).withColumn("value", F.when(F.col("level") == "overall", F.lit(math.nan)).otherwise(F.col("value"))), verify.long_ladder(p), "x")
    assert nan.where("not ok").agg(F.sum("beyond")).first()[0] == 12
    off = archive.withColumn("MAE", F.when(F.col("seed") == 2, F.col("MAE") + 1e-6).otherwise(F.col("MAE")))
    assert [(r["item"], r["beyond"]) for r in verify.archived(total, off, "a").where("not ok").collect()] == [("overall:mae", 1)]


def rows(spark):
    return spark.createDataFrame([("a", [1.0], 1.0), ("a", [math.nan], 1.0), ("b", [2.0], 0.0), ("c", None, 2.0), (None, [1.0], None)], "domain string, x array<double>, d double")


def test_totals_in_passing(spark, tmp_path):
    seen = passing.Passing({"a": 2, "b": 2, "z": 1}, numbers=("x", "d"), positive=("d",))
    seen.watch(rows(spark)).write.parquet(str(tmp_path / "t"))
    got = {r["item"]: (r["expected"], r["actual"], r["ok"]) for r in seen.report()}
    assert got == {"rows": (5, 5, True), "not finite": (0, 3, False), "not positive": (0, 2, False), "other groups": (0, 2, False), "domain:a": (2, 2, True), "domain:b": (2, 1, False), "domain:z": (1, 0, False)}
    with pytest.raises(integrity.ContractError, match="domain:b: 1, not 2"):
        seen.check()
    with pytest.raises(ValueError, match="one action"):
        seen.watch(rows(spark))
    empty = passing.Passing({})
    empty.watch(rows(spark).limit(0)).write.parquet(str(tmp_path / "e"))
    assert all(r["ok"] for r in empty.check())
    with pytest.raises(ValueError, match="at most"):
        passing.Passing({str(k): 1 for k in range(passing.MOST + 1)})
