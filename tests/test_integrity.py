"""Fault injection: coverage, identity, finiteness, shard reuse."""

import json
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import integrity
from plumbline.operators.store import ShardStore, fingerprint

KIND = "var_key string, sample_id string, domain string, pred array<double>, target array<double>, d double"


def entries(spark, n=6, **change):
    rows = [(f"a__{k % 2}", f"s{k}", "a", [float(k)] * 12, [k + 0.5] * 12, 1.0 + k) for k in range(n)]
    return spark.createDataFrame(rows, KIND)


def bad(spark, got, want):
    return {r["item"]: r["bad"] for r in integrity.coverage_report(got, want, 12).collect() if not r["ok"]}


def test_coverage_faults(spark):
    want = entries(spark)
    assert bad(spark, want, want) == {}
    integrity.verify_coverage(want, want, 12)
    assert bad(spark, want.where("sample_id <> 's1'"), want) == {"count": 1, "missing": 1}
    dup = want.where("sample_id <> 's1'").unionByName(want.where("sample_id = 's0'"))
    assert bad(spark, dup, want) == {"duplicates": 1, "missing": 1}
    with pytest.raises(integrity.ContractError, match="duplicates.*s0"):
        integrity.verify_coverage(dup, want, 12)
    assert bad(spark, want.withColumn("d", F.col("d") * (1 + 1e-12)), want) == {"values": 6}
    renamed = want.withColumn("sample_id", F.when(F.col("sample_id") == "s2", "zz").otherwise(F.col("sample_id")))
    assert bad(spark, renamed, want) == {"missing": 1, "extra": 1}
    nan = want.withColumn("target", F.when(F.col("sample_id") == "s2", F.array_repeat(F.lit(math.nan), 12)).otherwise(F.col("target")))
    assert bad(spark, nan, nan) == {"values": 1}  # NaN is not NaN here
    short = want.withColumn("target", F.slice("target", 1, 11))
    assert bad(spark, short, short) == {"values": 6}


def test_nulls_are_failures(spark):
    want = entries(spark)
    null = want.withColumn("d", F.when(F.col("sample_id") != "s2", F.col("d")))
    assert bad(spark, null, want) == {"values": 1}
    assert integrity.not_finite(null, "d", "pred").count() == 1


def test_verdicts(spark):
    v = lambda rows: tuple(integrity.verdict(spark.createDataFrame(rows, "ok boolean")).first())
    assert v([]) == (True, False, 0) and v([(True,), (None,)]) == (False, True, 2) and v([(True,)]) == (True, True, 1)


def test_merge_contract(spark):
    kind = "method string, seed int, domain string, var_key string"
    good = spark.createDataFrame([("S", 1, "a", "a__1"), ("S", 1, "b", "b__1")], kind)
    assert integrity.merge_checked(good, {"a", "b"}, 2) is good
    for rows, domains, n, what in (([("S", 1, "a", "a__1"), ("S", 1, "b", "a__1")], {"a", "b"}, 1, "several"), ([("S", 1, "a", "a__1")], {"a", "b"}, 1, "missing"), ([("S", 1, "a", "a__1")], {"a"}, 2, "1 variables")):
        with pytest.raises(integrity.ContractError, match=what):
            integrity.merge_checked(spark.createDataFrame(rows, kind), domains, n)


def test_gate_stops_at_first_failure():
    ran = []
    check = lambda name, ok: (name, lambda: (ran.append(name) or ok, "detail"))
    assert len(integrity.run_gate([check("a", True), check("b", True)])) == 2
    with pytest.raises(integrity.ContractError, match="d: detail"):
        integrity.run_gate([check("c", True), check("d", False), check("e", True)])
    assert ran == ["a", "b", "c", "d"]


def test_same_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert integrity.same_rows(a, a) and not integrity.same_rows(a, a.distinct())


def test_store(spark, tmp_path):
    s, want, fp = ShardStore(spark, f"file://{tmp_path}/shards"), entries(spark), fingerprint({"p": 1}, {"x.py": "0"}, step=48)
    key = ("S", 2021, "a")
    assert not s.reuse(*key, fp)  # nothing there yet
    s.save(*key, fp, want)
    assert s.reuse(*key, fp, want) and s.quarantined() == []
    assert integrity.same_rows(s.entries("S", [2021], ["a"]).drop("method", "seed"), want)
    assert s.entries("S", [2021], ["a"]).select("seed").first()[0] == 2021
    assert s.problems(*key, fp | {"step": 9}) == ["fingerprint"]
    with pytest.raises(integrity.ContractError):
        s.entries("S", [2021], ["a", "b"])
    # an unreadable manifest, and data that no manifest names
    path = tmp_path / "shards/method=S/seed=2021/domain=a/manifest.json"
    head = json.loads(path.read_text())
    path.write_text("{")
    (path.parent / ".manifest.json.crc").unlink(missing_ok=True)
    assert s.problems(*key, fp) == ["no data", "fingerprint"]
    path.write_text(json.dumps(head | {"n_rows": 5}))
    assert s.problems(*key, fp) == ["row count"]
    assert not s.reuse(*key, fp) and not s.reuse(*key, fp) and len(s.quarantined()) == 1
    first = s.save(*key, fp, want)
    assert s.save(*key, fp, want.repartition(5))["content_hash"] == first["content_hash"]  # files and order make no difference
    changed = want.withColumn("d", F.when(F.col("sample_id") == "s3", F.col("d") + 1e-12).otherwise(F.col("d")))
    assert s.save(*key, fp, changed)["content_hash"] != first["content_hash"]
    s.save(*key, fp, want.limit(2))  # a later save wins; what it replaces is not read
    assert s.entries("S", [2021], ["a"]).count() == 2


def test_store_all(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/shards")
    preds = entries(spark).withColumns({"method": F.lit("S"), "seed": F.explode(F.array(F.lit(1), F.lit(2)))})
    heads = s.save_all(preds, {"a": 1})
    assert [h["n_rows"] for h in heads] == [6, 6] and all(s.reuse("S", k, "a", {"a": 1}) for k in (1, 2))
    assert s.entries("S", [1, 2], ["a"]).count() == 12


def test_verify_is_one_job_for_all_shards(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/shards")
    assert s.verify({"a": 1}).count() == 0 and s.reuse_all({"a": 1}) == set()
    want = entries(spark, 12).withColumn("domain", F.concat(F.lit("d"), F.regexp_extract("sample_id", "[0-9]+", 0)))
    preds = want.withColumns({"method": F.lit("S"), "seed": F.explode(F.array(F.lit(1), F.lit(2))), "pos": F.lit(3)})

    def jobs(f):
        before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("count-jobs"))
        spark.sparkContext.setJobGroup("count-jobs", "")
        out = f()
        return out, len(set(spark.sparkContext.statusTracker().getJobIdsForGroup("count-jobs")) - before)

    s.save_all(preds.where("domain in ('d1', 'd2')"), {"a": 1})
    few, n_few = jobs(lambda: s.verify({"a": 1}, want).collect())
    s.save_all(preds, {"a": 1})
    many, n_many = jobs(lambda: s.verify({1: {"a": 1}, 2: {"b": 1}}, want, by_seed=True).collect())
    assert len(few) == 4 and len(many) == 24 and n_many <= n_few + 1
    assert {(r["seed"], tuple(r["problems"]), r["n_rows"]) for r in many} == {(1, (), 1), (2, ("fingerprint",), 1)}
    # a file that can't be read costs its shard only
    import glob
    import os

    broken = glob.glob(f"{tmp_path}/shards/method=S/seed=1/domain=d5/data-*/*.parquet")[0]
    crc = os.path.join(os.path.dirname(broken), f".{os.path.basename(broken)}.crc")
    os.path.exists(crc) and os.unlink(crc)
    open(broken, "wb").write(b"PAR1 no")
    assert {(r["domain"], tuple(r["problems"])) for r in s.verify({"a": 1}, want).where("seed = 1").collect() if r["problems"]} == {("d5", ("no data", "missing"))}
    assert s.reuse_all({"a": 1}) == {("S", k, f"d{i}") for k in (1, 2) for i in range(12)} - {("S", 1, "d5")} and len(s.quarantined()) == 1


def test_order_is_kept(spark, tmp_path):
    s = ShardStore(spark, f"file://{tmp_path}/shards")
    rows = spark.range(9000).select(F.concat(F.lit("v"), F.col("id") % 2).alias("var_key"), F.col("id").cast("string").alias("sample_id"), F.lit("a").alias("domain"), F.array(F.lit(1.0)).alias("pred"), F.array(F.lit(1.0)).alias("target"), F.lit(1.0).alias("d"), (9000 - F.col("id")).alias("pos"), F.lit("S").alias("method"), F.lit(1).alias("seed"))
    s.save_all(rows.repartition(7), {})
    assert s.in_order().collect()[0]["in_order"]
    got = [(r["var_key"], r["pos"]) for r in s.entries("S", [1], ["a"], ordered=True).collect()]
    assert got == sorted(got)
    back = s.spark.read.parquet(f"{s.shard_dir('S', 1, 'a')}/data-*").orderBy(F.rand(1))
    back.write.parquet(f"{s.shard_dir('S', 1, 'a')}/data-x")
    assert not s.in_order().collect()[0]["in_order"]
