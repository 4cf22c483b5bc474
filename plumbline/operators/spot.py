"""Spot checks: one window of each wanted variable, as three sources have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.windows import CONTEXT, HORIZON
from plumbline.sources import files, npz, zipjson

MOST = 10_000  # variables in one check


def spot_check(spark: SparkSession, members: dict[str, str], archive: str, manifest: str, cache: str, size: int, context: int = CONTEXT, horizon: int = HORIZON) -> DataFrame:
    """(var_key, sample_id, s, past_diff, target_diff, ok) for each variable of ``members`` (var_key: its member of the archive).

    The archive's first sample that the manifest lists gives the key; the manifest's start index finds the window in the cache (chunks of ``size`` points,
    which overlap by a window less one). Both windows must have their lengths and not differ at all. A variable without such a sample fails.

    Keys prune all sources: of the archive only the wanted members are opened, of the cache only files and series of the wanted variables and
    chunks. At most MOST variables; their windows, one each, pass through the driver.
    """
    if len(members) > MOST:
        raise ValueError(f"{len(members)} variables; a spot check takes at most {MOST}")
    wanted = sorted(members)
    samples = zipjson.samples(spark, archive, members=sorted(members.values())).where(F.col("var_key").isin(*wanted))
    starts = files.split_manifest(spark, manifest, lines=True)[1].where(F.col("var_key").isin(*wanted)).select(F.col("var_key").alias("key"), F.col("sample_id").alias("sid"), "s").distinct()
    listed = samples.join(starts, (F.col("var_key") == F.col("key")) & (F.col("sample_id") == F.col("sid"))).where(F.col("s").isNotNull())
    first = F.min_by(F.struct("sample_id", "s", "past", "target"), F.struct("future_start", F.coalesce("idx", F.lit(0)), "sample_id"))
    found = {r["var_key"]: r["x"] for r in listed.groupBy("var_key").agg(first.alias("x")).collect()}  # a row a wanted variable
    rows = [(k, *(found[k] if k in found else (None,) * 4)) for k in wanted]
    keys = spark.createDataFrame(rows, "var_key string, sample_id string, s int, past array<double>, target array<double>").withColumn("chunk", F.floor(F.col("s") / size))
    chunks = sorted({int(x["s"]) // size for x in found.values()})
    near = npz.ragged_series(spark, cache, sorted(found), chunks)
    rows = keys.join(near.withColumnsRenamed({"var_key": "c_key", "chunk": "c_chunk"}), (F.col("var_key") == F.col("c_key")) & (F.col("chunk") == F.col("c_chunk")), "left")
    at = F.col("s") - F.col("chunk").cast("int") * size
    own = {"past": F.slice("values", at + 1, context), "target": F.slice("values", at + context + 1, horizon)}

    def diff(name: str, length: int):
        same_length = (F.size(own[name]) == length) & (F.size(name) == length)
        return F.when(same_length, F.array_max(F.zip_with(own[name], name, lambda a, b: F.abs(a - b)))).alias(f"{name}_diff")

    out = rows.select("var_key", "sample_id", "s", diff("past", context), diff("target", horizon))
    return out.withColumn("ok", F.coalesce((F.col("past_diff") == 0) & (F.col("target_diff") == 0), F.lit(False)))
