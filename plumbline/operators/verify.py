"""Independent verification: the ladder by a second route, held against the first and against an archived table, as one evidence table.

The first route folds arrays within a window and takes means of exact sums. The second never builds an array: every step of every window is a row,
errors are squared row by row, and each level is a plain group-by with Spark's own mean. What both agree on does not rest on either's code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import METRICS, RUN, ladder

#: Within a level: scaled errors are of the order of one and held to an absolute tolerance, raw ones to a relative one.
ATOL, RTOL = 1e-12, 1e-12
#: An archive has six decimals.
ARCHIVE_TOL = 5e-7


def long_ladder(preds: DataFrame) -> DataFrame:
    """(level, method, seed, key, metric, value) from preds (method, seed, domain, var_key, sample_id, pred, target, d), one exploded row a step."""
    return long_ladder_of(long_variables(preds))


def long_variables(preds: DataFrame) -> DataFrame:
    """The variables' level of the second route, which its other levels read."""
    steps = preds.select(*RUN, "domain", "var_key", "sample_id", "d", F.posexplode("target").alias("h", "y"), "pred")
    e = F.element_at("pred", F.col("h") + 1) - F.col("y")
    z = e / F.col("d")
    window = steps.groupBy(*RUN, "domain", "var_key", "sample_id").agg(F.avg(z * z).alias("mse"), F.avg(F.abs(z)).alias("mae"), F.avg(e * e).alias("raw_mse"), F.avg(F.abs(e)).alias("raw_mae"))
    return window.groupBy(*RUN, "domain", "var_key").agg(*[F.avg(m).alias(m) for m in METRICS])


def long_ladder_of(by_var: DataFrame) -> DataFrame:
    values = [F.avg(m).alias(m) for m in METRICS]
    by_domain = by_var.groupBy(*RUN, "domain").agg(*values)
    overall = by_domain.groupBy(*RUN).agg(*values)
    out = None
    for name, f, key in (("variable", by_var, F.col("var_key")), ("domain", by_domain, F.col("domain")), ("overall", overall, F.lit(""))):
        cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("c")
        rows = f.withColumn("level", F.lit(name)).withColumn("key", key).select("level", *RUN, "key", cells).select("level", *RUN, "key", "c.metric", "c.value")
        out = rows if out is None else out.unionByName(rows)
    return out


CELL = ("level", *RUN, "key", "metric")


def agreement(a: DataFrame, b: DataFrame, section: str, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """(section, item, cells, one_sided, max_abs, max_rel, beyond, ok) of two ladders, an item a level and metric.

    A cell is beyond if it differs by more than ``atol`` (scaled metrics) or ``rtol`` of its size (raw ones), if only one side has it, or if
    either is no number. Both sides meet in one shuffle by cell.
    """
    sides = a.select(*CELL, F.col("value").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    sides = sides.unionByName(b.select(*CELL, F.lit(None).cast("double").alias("x"), F.col("value").alias("y"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    cell = sides.groupBy(*CELL).agg(F.max("x").alias("x"), F.max("y").alias("y"), F.sum("in_a").alias("n"), F.sum("in_b").alias("m"))
    d = F.abs(F.col("x") - F.col("y"))
    off = F.when(F.col("metric").startswith("raw"), d > rtol * F.abs("y")).otherwise(d > atol)
    one = (F.col("n") != 1) | (F.col("m") != 1)
    bad = one | F.coalesce(F.isnan(d) | off, F.lit(True))
    out = cell.groupBy("level", "metric").agg(F.count(F.lit(1)).alias("cells"), F.count_if(one).alias("one_sided"), F.max(d).alias("max_abs"), F.max(d / F.greatest(F.abs("y"), F.lit(1e-300))).alias("max_rel"), F.count_if(bad).alias("beyond"))
    return out.select(F.lit(section).alias("section"), F.concat_ws(":", "level", "metric").alias("item"), "cells", "one_sided", "max_abs", "max_rel", "beyond", (F.col("beyond") == 0).alias("ok"))


def archived(overall: DataFrame, archive: DataFrame, section: str, tol: float = ARCHIVE_TOL) -> DataFrame:
    """The same columns for overall values (method, seed, mse, mae) against an archived table (method, seed, MSE, MAE) of six decimals."""
    own = overall.select(*RUN, F.explode(F.create_map(F.lit("mse"), F.col("mse"), F.lit("mae"), F.col("mae"))).alias("metric", "value")).select(F.lit("overall").alias("level"), *RUN, F.lit("").alias("key"), "metric", "value")
    old = archive.select(*RUN, F.explode(F.create_map(F.lit("mse"), F.col("MSE"), F.lit("mae"), F.col("MAE"))).alias("metric", "value")).select(F.lit("overall").alias("level"), *RUN, F.lit("").alias("key"), "metric", "value")
    return agreement(own, old, section, atol=tol)


def verify(scored: DataFrame, preds: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Evidence that two routes, and the archive if there is one, agree on all cells: the rows of ``agreement``."""
    from plumbline.operators.metrics import domain_level, overall_level, variable_level

    rows = agreement(ladder(scored), long_ladder(preds), "two routes")
    return rows if archive is None else rows.unionByName(archived(overall_level(domain_level(variable_level(scored))), archive, "archive"))
