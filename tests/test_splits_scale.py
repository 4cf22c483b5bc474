"""Windows made from a few lengths are many: no plan may broadcast them."""

from pyspark.sql import functions as F

from plumbline.operators import series, splits, windows


def broadcasts(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastExchange" in x]


def lengths(spark):
    return spark.createDataFrame([("d", "d__a", 5000), ("d", "d__b", 4000)], "domain string, var_key string, n long")


def test_windows_of_lengths_are_not_broadcast(spark):
    other = spark.range(100_000).select(F.concat(F.lit("d__"), F.col("id").cast("string")).alias("var_key"), F.array_repeat(F.col("id"), 50).alias("x"))
    assert not broadcasts(splits.native(lengths(spark), 4).select("var_key", "s").join(other, "var_key"))


def test_starts_of_lengths_are_not_broadcast(spark):
    pts = spark.range(9000).select(F.lit("d").alias("domain"), F.when(F.col("id") < 5000, "d__a").otherwise("d__b").alias("var_key"), (F.col("id") % 5000).cast("int").alias("i"), F.col("id").cast("double").alias("v"))
    starts = lengths(spark).select("domain", "var_key", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"), F.lit(200))).alias("s"))
    got = windows.cut_at(pts, starts)
    assert not broadcasts(got) and got.count() == 25 + 20


def test_windows_keep_what_lengths_say(spark):
    got = splits.native(lengths(spark).withColumn("std", F.col("n") / 2), 4)
    assert {(r["var_key"], r["std"]) for r in got.select("var_key", "std").distinct().collect()} == {("d__a", 2500.0), ("d__b", 2000.0)}
    plain = splits.native(lengths(spark), 4)
    assert plain.columns == ["domain", "var_key", "sample_id", "split", "pos", "s"] and plain.count() == got.count()
