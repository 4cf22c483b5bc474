"""Comparisons of methods, tables and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.exact import exact_avg
from plumbline.functions.scalar import relative_improvement
from plumbline.operators.metrics import melt


def improvement_counts(level: DataFrame, key: str, reference: str, metrics: tuple[str, ...] = ("mse", "mae")) -> DataFrame:
    """(method, metric, improved, degraded, equal, total): seeds are averaged first, then each key is compared with the reference method."""
    means = melt(level, key, metrics=metrics).groupBy("method", key, "metric").agg(exact_avg("value").alias("value"))
    # the reference's value reaches the others of its key by a window: the ladder below is computed once, not once a side
    ref = F.max(F.when(F.col("method") == reference, F.col("value"))).over(Window.partitionBy(key, "metric"))
    both = means.withColumn("ref", ref).where((F.col("method") != reference) & F.col("ref").isNotNull())
    return both.groupBy("method", "metric").agg(
        F.count_if(F.col("value") < F.col("ref")).alias("improved"),
        F.count_if(F.col("value") > F.col("ref")).alias("degraded"),
        F.count_if(F.col("value") == F.col("ref")).alias("equal"),
        F.count(F.lit(1)).alias("total"),
    )


def comparisons(overall: DataFrame, pairs: list[tuple[str, str]], metrics: tuple[str, ...] = ("mse", "mae")) -> DataFrame:
    """(comparison, metric, delta, relative_improvement in percent) of named pairs; the ratio is null against 0."""
    means = melt(overall, metrics=metrics).groupBy("method", "metric").agg(exact_avg("value").alias("value"))
    named = overall.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    a = means.select(F.col("method").alias("a"), "metric", F.col("value").alias("va"))
    b = means.select(F.col("method").alias("b"), "metric", F.col("value").alias("vb"))
    rows = named.join(a, "a").join(b, ["b", "metric"])
    return rows.select("k", F.concat_ws("-", "a", "b").alias("comparison"), "metric", (F.col("va") - F.col("vb")).alias("delta"), relative_improvement(F.col("va"), F.col("vb")).alias("relative_improvement")).orderBy("k", F.col("metric").desc()).drop("k")


def with_fallback(by_domain: DataFrame, selection: DataFrame, reference: str) -> DataFrame:
    """(method, seed, overall_mse, overall_mae, n_fallback, n_domains): flagged runs take the reference's domain score.

    ``selection``: (method, seed, domain, fallback). A selected run without a score makes the row null, not smaller.
    """
    ref = by_domain.where(F.col("method") == reference).select("domain", F.col("mse").alias("r_mse"), F.col("mae").alias("r_mae"))
    own = by_domain.select("method", "seed", "domain", "mse", "mae")
    rows = selection.join(own, ["method", "seed", "domain"], "left").join(ref, "domain", "left")
    for m in ("mse", "mae"):
        rows = rows.withColumn(f"x_{m}", F.when(F.col("fallback"), F.col(f"r_{m}")).otherwise(F.col(m)))
    whole = F.count_if(F.col("x_mse").isNull()) == 0
    return rows.groupBy("method", "seed").agg(
        F.when(whole, exact_avg("x_mse")).alias("overall_mse"),
        F.when(whole, exact_avg("x_mae")).alias("overall_mae"),
        F.count_if(F.col("fallback")).alias("n_fallback"),
        F.count(F.lit(1)).alias("n_domains"),
    )


def best_epoch(curve: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "val_mse", tolerance: float = 0.0) -> DataFrame:
    """The earliest epoch whose value is within ``tolerance`` of the run's best. Incomparable (NaN) values never win."""
    ok = curve.where(~F.isnan(value))
    best = ok.groupBy(run).agg(F.min(value).alias("best"))
    return ok.join(best, run).where(F.col(value) <= F.col("best") + tolerance).groupBy(run).agg(F.min(F.struct(epoch, value)).alias("m")).select(run, F.col(f"m.{epoch}").alias(epoch), F.col(f"m.{value}").alias(value))


def diff(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], atol: float = 0.0) -> DataFrame:
    """One row: cells compared, keys on one side only, largest absolute and relative difference, cells beyond ``atol``."""
    left = a.unpivot(keys, values, "field", "x")
    right = b.unpivot(keys, values, "field", "y")
    d = F.abs(F.col("x") - F.col("y"))
    both = F.col("in_a") & F.col("in_b")
    rows = left.withColumn("in_a", F.lit(True)).join(right.withColumn("in_b", F.lit(True)), [*keys, "field"], "full_outer").fillna(False, ["in_a", "in_b"])
    return rows.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(~both).alias("one_sided"),
        F.max(F.when(both, d)).alias("max_abs"),
        F.max(F.when(both, d / F.greatest(F.abs("x"), F.lit(1e-12)))).alias("max_rel"),
        F.count_if(both & ~F.coalesce(d <= atol, F.lit(False))).alias("beyond"),
    )


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("r_ = 1").drop("r_")


def extrapolate(timings: DataFrame, ms: str, windows: int, seeds: int) -> DataFrame:
    """(mean_ms, minutes) of a full run at the mean latency; a plan, not a measurement."""
    return timings.agg(F.avg(ms).alias("mean_ms")).withColumn("minutes", F.col("mean_ms") * windows * seeds / 60000.0)
