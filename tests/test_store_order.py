"""Shards of constant method and seed keep the order of their windows, in every file and from file to file."""

from pyspark.sql import functions as F

from plumbline.operators import store


def windows_of(spark, n):
    i = F.col("id")
    rows = spark.range(n).select(F.when(i % 3 == 0, "d1").when(i % 3 == 1, "d2").otherwise("d3").alias("domain"), F.lit("N0").alias("method"), F.lit(0).alias("seed"), ((n - 1 - i) * 4).alias("pos"))
    rows = rows.withColumns({"var_key": F.concat_ws("__", "domain", F.lit("v")), "pred": F.array_repeat(F.lit(1.0), 12), "target": F.array_repeat(F.lit(2.0), 12), "d": F.lit(1.0)})
    return rows.withColumn("sample_id", F.concat_ws("__", "var_key", F.col("pos").cast("string")))


def test_constant_keys_keep_the_order(spark, tmp_path):
    shards = store.ShardStore(spark, f"file://{tmp_path}/s")
    heads = shards.save_all(windows_of(spark, 3000).repartition(7), {"a": 1})
    assert [(h["shard"], h["n_rows"]) for h in heads] == [(f"N0__d{k}__s0", 1000) for k in (1, 2, 3)]
    assert {r["domain"]: r["in_order"] for r in shards.in_order().collect()} == {"d1": True, "d2": True, "d3": True}
