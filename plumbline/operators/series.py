"""Tables to series: ordinals of points, and points as arrays in chunks of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import EPS, array_pstd, scale_or_fallback, var_key

CHUNK = 2048
TASK_ROWS = 1 << 18


def parts_of(df: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Into how many parts to deal so many rows: so that a task has about ``task_rows``, however many there are. Counts them; for tables, whose files know.

    Adaptive execution joins parts by their compressed bytes, of which sorted keys leave next to nothing: 64 MB of them take over a GB to sort.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))


def points(df: DataFrame, domain: Column, var: Column, value: Column, order: list[str], bucket: Column, parts: int | None = None) -> DataFrame:
    """(domain, var_key, i, v): i is the 0-based position of a row in its series by ``order``.

    ``bucket`` is a function of the first ordering column that never falls as it rises. Rows meet per series and bucket only, in ``parts`` tasks
    if given (see ``parts_of``); the buckets' row counts give each bucket its first position. So a series of any length is numbered by many tasks.
    """
    at = F.struct(bucket.alias("at"))  # a struct of a null equals itself, so that rows meet their offsets where they lie
    rows = df.select(domain.alias("domain"), var_key(domain, var).alias("var_key"), value.cast("double").alias("v"), at.alias("bucket"), *order)
    counts = rows.groupBy("var_key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("var_key").orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("var_key").alias("o_key"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("var_key", "bucket").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    if parts:
        rows, offsets = rows.repartition(parts, "var_key", "bucket"), offsets.repartition(parts, "o_key", "o_bucket")
    placed = rows.withColumn("nth", F.row_number().over(within)).join(offsets, (F.col("var_key") == F.col("o_key")) & (F.col("bucket") == F.col("o_bucket")))
    return placed.select("domain", "var_key", (F.col("ahead") + F.col("nth") - 1).cast("int").alias("i"), "v")


def lengths(pts: DataFrame) -> DataFrame:
    return pts.groupBy("domain", "var_key").agg(F.count(F.lit(1)).alias("n"))


def fallback_std(pts: DataFrame, first: int = 96, eps: float = EPS) -> DataFrame:
    """(var_key, fallback_std): population standard deviation of a series' ``first`` points, 1 where that is too small. Summed in their order."""
    got = pts.where((F.col("i") < first) & F.col("v").isNotNull()).groupBy("var_key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("x"))
    s = got.select("var_key", array_pstd(F.transform("x", lambda x: x["v"])).alias("s"))
    return s.select("var_key", scale_or_fallback(F.col("s"), F.lit(1.0), eps).alias("fallback_std"))


def arrays(pts: DataFrame) -> DataFrame:
    """(domain, var_key, values): one array a series. For series of bounded length; see ``chunks`` for others."""
    got = F.array_sort(F.collect_list(F.struct("i", "v")))
    return pts.groupBy("domain", "var_key").agg(F.transform(got, lambda x: x["v"]).alias("values"))


def dealt(pts: DataFrame, overlap: int, size: int) -> DataFrame:
    """``pts`` with its chunk; a point whose position lies in the first ``overlap`` of a chunk is in the chunk before, too."""
    if overlap > size:
        raise ValueError("a chunk must be at least as long as the overlap")
    own = F.floor(F.col("i") / size).cast("int")
    in_two = (F.col("i") % size < overlap) & (F.col("i") >= size)
    return pts.withColumn("chunk", F.explode(F.when(in_two, F.array(own - 1, own)).otherwise(F.array(own))))


def chunks(pts: DataFrame, overlap: int, size: int = CHUNK) -> DataFrame:
    """(domain, var_key, chunk, values): points size*chunk .. size*(chunk+1)+overlap-1 of each series, as far as they exist.

    A point whose position lies in the first ``overlap`` of a chunk stands at the end of the chunk before, too.
    """
    got = F.array_sort(F.collect_list(F.struct("i", "v")))
    return dealt(pts, overlap, size).groupBy("domain", "var_key", "chunk").agg(F.transform(got, lambda x: x["v"]).alias("values"))
