"""Windows of a context and a target over series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import scale_or_fallback, window_scale
from plumbline.operators import series

CONTEXT, HORIZON = 96, 12


def _id():
    return F.concat_ws("__", "var_key", F.col("s").cast("string")).alias("sample_id")


def cut(pts: DataFrame, stride: int, context: int = CONTEXT, horizon: int = HORIZON, chunk: int = series.CHUNK) -> DataFrame:
    """(domain, var_key, sample_id, s, past, target) for starts 0, stride, 2*stride, ... of which all points exist.

    Slices are taken inside each chunk's array before they are exploded, so no row carries a series.
    """
    span = context + horizon
    size = -(-chunk // stride) * stride
    parts = series.chunks(pts, span - 1, max(size, -(-span // stride) * stride))
    size = max(size, -(-span // stride) * stride)
    starts = F.when(F.size("values") >= span, F.sequence(F.lit(0), F.least(F.size("values") - span, F.lit(size - stride)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    cuts = F.transform(starts, lambda o: F.struct((F.col("chunk") * size + o).alias("s"), F.slice("values", o + 1, context).alias("past"), F.slice("values", o + context + 1, horizon).alias("target")))
    rows = parts.select("domain", "var_key", F.explode(cuts).alias("w"))
    return rows.select("domain", "var_key", F.col("w.s").alias("s"), F.col("w.past").alias("past"), F.col("w.target").alias("target")).select("domain", "var_key", _id(), "s", "past", "target")


def summaries(pts: DataFrame, stride: int, context: int = CONTEXT, horizon: int = HORIZON, chunk: int = series.CHUNK, parts: int | None = None) -> DataFrame:
    """(domain, var_key, sample_id, s, last, mean, std, target) of the windows of ``cut``, without their contexts.

    Points are laid in blocks as long as a context. A context is the rest of one block and the beginning of the next; the moments of both come from
    running means and variances, forwards and backwards within a block, and are merged. So a window costs a few values whatever
    its length, and as nothing is subtracted from running sums, a small deviation beside large values stays exact. A context
    with a null or NaN has NaN for mean and std. Chunks are dealt once, to ``parts`` tasks if given (``series.parts_of``).
    """
    span = context + horizon
    size = max(-(-chunk // stride) * stride, -(-span // stride) * stride)
    rows = series.dealt(pts, span - 1, size)
    rows = rows.repartition(*[parts] * bool(parts), "var_key", "chunk").withColumns({"block": F.floor(F.col("i") / context), "x": F.coalesce("v", F.lit(float("nan")))})
    whole = Window.partitionBy("var_key", "chunk").orderBy("block", "i")  # blocks rise with places: the order that ``up`` leaves
    of_block = Window.partitionBy("var_key", "chunk", "block")
    up, down = (of_block.orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col("i").asc(), F.col("i").desc()))
    rows = rows.withColumns({"rest_m": F.avg("x").over(down), "rest_v": F.var_pop("x").over(down)}).withColumns({"m": F.avg("x").over(up), "var": F.var_pop("x").over(up)})
    ahead = lambda c, k: F.lead(c, k).over(whole)
    rows = rows.withColumns({"next_m": ahead("m", context - 1), "next_v": ahead("var", context - 1), "last": ahead("v", context - 1), "end": ahead("i", span - 1), "target": F.array(*[ahead("v", context + h) for h in range(horizon)])})
    rows = rows.where((F.floor(F.col("i") / size) == F.col("chunk")) & (F.col("i") % stride == 0) & F.col("end").isNotNull())
    n, after = F.lit(float(context)), (F.col("i") % context).cast("double")
    ahead_of = n - after
    gap = F.col("next_m") - F.col("rest_m")
    moment = ahead_of * F.col("rest_v") + after * F.col("next_v") + gap * gap * ahead_of * after / n
    alone = F.col("i") % context == 0
    mean = F.when(alone, F.col("rest_m")).otherwise(F.col("rest_m") + gap * after / n)
    std = F.sqrt(F.when(alone, F.col("rest_v")).otherwise(moment / n))
    rows = rows.select("domain", "var_key", F.col("i").alias("s"), "last", mean.alias("mean"), std.alias("std"), "target")
    return rows.select("domain", "var_key", _id(), "s", "last", "mean", "std", "target")


def cut_at(pts: DataFrame, starts: DataFrame, context: int = CONTEXT, horizon: int = HORIZON, chunk: int = series.CHUNK) -> DataFrame:
    """Windows at given ``starts`` (var_key, s, ...): an equi-join with the chunk that holds the start. Windows that would be cut short are left out."""
    span = context + horizon
    parts = series.chunks(pts, span - 1, max(chunk, span)).select(F.col("var_key").alias("c_key"), "chunk", "values")
    size = max(chunk, span)
    wanted = starts.withColumn("w_chunk", F.floor(F.col("s") / size).cast("int")).hint("merge")  # starts are often made from lengths, and seem as few
    rows = wanted.join(parts, (F.col("var_key") == F.col("c_key")) & (F.col("w_chunk") == F.col("chunk")))
    o = F.col("s") - F.col("chunk") * size
    rows = rows.withColumns({"past": F.slice("values", o + 1, context), "target": F.slice("values", o + context + 1, horizon)})
    return rows.where((F.size("past") == context) & (F.size("target") == horizon)).drop("c_key", "w_chunk", "chunk", "values")


def cut_frames(pts: DataFrame, stride: int, context: int = CONTEXT, horizon: int = HORIZON, chunk: int = series.CHUNK) -> DataFrame:
    """The same windows by row frames: a second way to the same rows, to compare with.

    Frames run within a chunk and the points after it that its last windows reach, so no task sorts a series.
    """
    overlap = context + horizon - 1
    size = max(chunk, overlap)
    dealt = series.dealt(pts, overlap, size)
    w = Window.partitionBy("var_key", "chunk").orderBy("i")
    rows = dealt.withColumns({
        "past": F.collect_list("v").over(w.rowsBetween(0, context - 1)),
        "target": F.collect_list("v").over(w.rowsBetween(context, context + horizon - 1)),
    })
    own = F.floor(F.col("i") / size) == F.col("chunk")
    rows = rows.where(own & (F.col("i") % stride == 0) & (F.size("target") == horizon)).withColumnRenamed("i", "s")
    return rows.select("domain", "var_key", _id(), "s", "past", "target")


def with_scale(wins: DataFrame, fallback: DataFrame) -> DataFrame:
    """Adds d, the scoring scale: the deviation of the context (``past``, or ``std`` of summaries) or else the series' fallback (var_key, fallback_std).

    The fallback is a row a series and goes to the windows, which stay where they lie: by their few keys, all windows of a series would meet in one task.
    """
    own = window_scale(F.col("past"), F.col("fallback_std")) if "past" in wins.columns else scale_or_fallback(F.col("std"), F.col("fallback_std"))
    return wins.join(F.broadcast(fallback), "var_key", "left").withColumn("d", own).drop("fallback_std")


def long_form(wins: DataFrame) -> DataFrame:
    """(domain, var_key, sample_id, k, v): k counts on from the context into the target."""
    return wins.select("domain", "var_key", "sample_id", F.posexplode(F.concat("past", "target")).alias("k", "v"))
