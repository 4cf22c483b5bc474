"""The metric ladder: window -> variable -> domain -> overall, with equal weight at each step, then over seeds.

Never rollup or cube: those would pool the rows and weigh large groups more. Means are of exact sums (``functions.exact``), so that every
level has the same bits on any partitioning and in any order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exact import exact_avg, sample_std
from plumbline.functions.scalar import errors, mean_abs, mean_square, scaled

METRICS = ("mse", "mae", "raw_mse", "raw_mae")
RUN = ("method", "seed")


def score(preds: DataFrame) -> DataFrame:
    """preds (method, seed, domain, var_key, sample_id, pred, target, d) -> the same keys with the four metrics."""
    e = preds.withColumn("e", errors(F.col("pred"), F.col("target"))).withColumn("z", scaled(F.col("e"), F.col("d")))
    return e.select(*RUN, "domain", "var_key", "sample_id", mean_square(F.col("z")).alias("mse"), mean_abs(F.col("z")).alias("mae"), mean_square(F.col("e")).alias("raw_mse"), mean_abs(F.col("e")).alias("raw_mae"))


def variable_level(scored: DataFrame) -> DataFrame:
    return scored.groupBy(*RUN, "domain", "var_key").agg(*[exact_avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n"))


def domain_level(by_var: DataFrame) -> DataFrame:
    return by_var.groupBy(*RUN, "domain").agg(*[exact_avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_vars"))


def overall_level(by_domain: DataFrame) -> DataFrame:
    return by_domain.groupBy(*RUN).agg(*[exact_avg(m).alias(m) for m in METRICS], F.count(F.lit(1)).alias("n_domains"))


def over_seeds(level: DataFrame, *keys: str) -> DataFrame:
    """(method, keys, metric_mean, metric_std, n_seeds); the sample standard deviation of one run is null."""
    aggs = [f(m).alias(f"{m}_{name}") for m in METRICS for f, name in ((exact_avg, "mean"), (sample_std, "std"))]
    return level.groupBy("method", *keys).agg(*aggs, F.count(F.lit(1)).alias("n_seeds"))


def melt(level: DataFrame, *keys: str, metrics: tuple[str, ...] = ("mse", "mae")) -> DataFrame:
    """One row a metric: (method, seed, keys, metric, value)."""
    return level.unpivot([*[c for c in RUN if c in level.columns], *keys], list(metrics), "metric", "value")


def ladder(scored: DataFrame) -> DataFrame:
    """(level, method, seed, key, metric, value) of all levels above the windows."""
    return ladder_of(variable_level(scored))


def ladder_of(by_var: DataFrame) -> DataFrame:
    """The same from the variables' level, which all levels read: keep it in a file where the windows are many."""
    by_domain = domain_level(by_var)
    levels = (("variable", by_var, F.col("var_key")), ("domain", by_domain, F.col("domain")), ("overall", overall_level(by_domain), F.lit("")))
    parts = [melt(f.withColumn("key", key), "key", metrics=METRICS).withColumn("level", F.lit(name)) for name, f, key in levels]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("level", *RUN, "key", "metric", "value")


def bit_equal(scored: DataFrame, partitions: tuple[int, ...] = (7, 64), keep: Callable[[DataFrame], DataFrame] = lambda by_var: by_var) -> DataFrame:
    """(level, cells, unequal): cells of the ladder that are not bit for bit the same for ``scored`` as it lies and dealt to so many partitions.

    Bits are compared by the hash of the double, so that 0.0 and -0.0 differ, and one NaN equals another. ``keep`` may put each layout's
    variables into a file, so that the windows are read once a layout. Rows are dealt by their values, which needs no sort.
    """
    rows = ladder_of(keep(variable_level(scored))).withColumn("layout", F.lit(0))
    for n in partitions:
        rows = rows.unionByName(ladder_of(keep(variable_level(scored.repartition(n, *METRICS)))).withColumn("layout", F.lit(n)))
    bits = F.concat_ws("|", F.col("value").cast("string"), F.xxhash64("value").cast("string"))
    cells = rows.groupBy("level", *RUN, "key", "metric").agg(F.count(F.lit(1)).alias("n"), F.min(bits).alias("a"), F.max(bits).alias("b"))
    return cells.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.count_if((F.col("n") != 1 + len(partitions)) | (F.col("a") != F.col("b"))).alias("unequal"))
