"""A task of the window steps has about so many rows, however many there are."""

from pyspark.sql import functions as F

from plumbline.operators import series, windows
from plumbline.plans import queries


def test_parts_follow_rows(spark):
    assert series.parts_of(spark.range(1001), 100) == 11
    assert series.parts_of(spark.range(10), 100) == spark.sparkContext.defaultParallelism


def test_tasks_stay_small(spark):
    df = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("s"), F.col("id").alias("t"), (F.col("id") % 97).cast("double").alias("x"))
    pts = series.points(df, F.col("s"), F.lit("v"), F.col("x"), ["t"], F.floor(F.col("t") / 300), parts=12)
    largest = lambda d: d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert pts.count() == 60_000 and largest(pts) < 12_000
    wins = windows.summaries(pts, 1, chunk=256, parts=12)
    assert wins.count() == 3 * (20_000 - 107) and largest(wins) < 12_000


def test_scale_leaves_windows_where_they_lie(spark):
    limits = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    pts = spark.range(60_000).select((F.col("id") % 3).cast("string").alias("domain"), F.concat_ws("__", (F.col("id") % 3).cast("string"), F.lit("v")).alias("var_key"), F.floor(F.col("id") / 3).cast("int").alias("i"), (F.col("id") % 97).cast("double").alias("v"))
    for c in limits:
        spark.conf.set(c, "-1")  # as if the fallback came last: a join by key moves the windows
    try:
        wins = windows.with_scale(windows.summaries(pts, 1, chunk=256, parts=12), series.fallback_std(pts))
        rows = wins.groupBy(F.spark_partition_id()).agg(F.count_if(F.col("d") > 0).alias("n")).agg(F.sum("n"), F.max("n")).first()
        assert rows[0] == 3 * (20_000 - 107) and rows[1] < 12_000
    finally:
        for c in limits:
            spark.conf.unset(c)


def test_null_bucket(spark):
    df = spark.createDataFrame([("a", None, 5.0), ("a", 9, 1.0), ("a", 1, 2.0), ("a", None, 5.0)], "s string, t int, x double")
    for parts in (None, 3):
        got = series.points(df, F.col("s"), F.lit("v"), F.col("x"), ["t"], F.floor(F.col("t") / 7), parts).collect()
        assert sorted((r["i"], r["v"]) for r in got) == [(0, 5.0), (1, 5.0), (2, 2.0), (3, 1.0)]


def test_queries_deal_by_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(series, "parts_of", lambda df: 37)
    for q in (queries.window_metrics, queries.comparisons):
        assert q(spark, sf)._jdf.queryExecution().executedPlan().toString().count(", 37), REPARTITION_BY_NUM") >= 3


def test_fallbacks_score_windows_once(spark, sf):
    plan = queries.fallback_summary(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_extendedprice" not in plan and plan.count("Relation") >= 3  # the variables' level, from its file
