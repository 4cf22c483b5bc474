"""Train, validation and test windows, and the row selections made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import derive_seed, timestamp_id
from plumbline.operators.windows import CONTEXT, HORIZON

BLOCK = 8192


def boundaries(lengths: DataFrame, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """(domain, t_train, t_val): the least of the variables' own boundaries, so that no variable of a domain looks past them."""
    return lengths.groupBy("domain").agg(
        F.min(F.floor(F.col("n") * train)).alias("t_train"),
        F.min(F.floor(F.col("n") * (train + val))).alias("t_val"),
    )


def native(lengths: DataFrame, stride: int, context: int = CONTEXT, horizon: int = HORIZON, block: int = BLOCK) -> DataFrame:
    """(domain, var_key, sample_id, split, pos, s). Targets lie wholly in their split; windows that straddle are excluded.

    The starts of a split are an arithmetic progression, so a position follows from its start; starts are made in blocks of ``block``.
    What else ``lengths`` says of a variable goes on to its windows. The planner takes the windows for as many as the variables they
    are made from, so joins with them are merged by hint: otherwise all windows would be broadcast.
    """
    more = [c for c in lengths.columns if c not in ("domain", "var_key", "n")]
    span = context + horizon
    n = F.floor((F.col("n") - span) / stride) + 1
    series = lengths.where(F.col("n") >= span).join(boundaries(lengths), "domain").withColumn("starts", n)
    blocks = series.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("starts") - 1) / block).cast("int"))))
    last_of = F.least(F.col("starts"), (F.col("b").cast("long") + 1) * block) - 1
    rows = blocks.withColumn("s", F.explode(F.sequence((F.col("b").cast("long") * block * stride), last_of * stride, F.lit(stride).cast("long"))))
    first, last = F.col("s") + context, F.col("s") + span
    train, val, test = last <= F.col("t_train"), (first >= F.col("t_train")) & (last <= F.col("t_val")), first >= F.col("t_val")
    rows = rows.withColumn("split", F.when(train, "train").when(val, "val").when(test, "test")).where(F.col("split").isNotNull())

    def ahead(boundary: str) -> Column:
        """Number of the first start whose target begins at the boundary or later."""
        return F.ceil(F.greatest(F.col(boundary) - context, F.lit(0)) / stride)

    pos = F.floor(F.col("s") / stride) - F.when(F.col("split") == "val", ahead("t_train")).when(F.col("split") == "test", ahead("t_val")).otherwise(F.lit(0))
    return rows.select("domain", "var_key", F.concat_ws("__", "var_key", F.col("s").cast("string")).alias("sample_id"), "split", pos.cast("int").alias("pos"), F.col("s").cast("int").alias("s"), *more).hint("merge")


def dense(lengths: DataFrame, context: int = CONTEXT, horizon: int = HORIZON) -> DataFrame:
    """Every start that the training split allows."""
    return native(lengths, 1, context, horizon).where("split = 'train'")


def of_split(splits: DataFrame, *names: str, domain: str | None = None) -> DataFrame:
    rows = splits.where(F.col("split").isin(*names))
    return rows if domain is None else rows.where(F.col("domain") == domain)


def capped(splits: DataFrame, per_var: int, names: tuple[str, ...] = ("train", "val"), domain: str | None = None) -> DataFrame:
    """At most ``per_var`` rows of each variable, in order of the splits named and of position."""
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("split"))
    order = Window.partitionBy("var_key").orderBy(rank, "pos")
    return of_split(splits, *names, domain=domain).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_var).drop("r")


def balanced_draws(splits: DataFrame, per_var: int, seed: int) -> DataFrame:
    """Sampling with replacement, ``per_var`` draws from each variable: draw k takes the row that a hash of (seed, variable, k) numbers.

    Rows are numbered by split and position, which run from 0 without gaps in each split as ``native`` and ``capped`` give them; a draw finds its
    split by the splits' counts, so no variable's rows are ranked.
    """
    counts = splits.groupBy("var_key", "split").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("var_key").orderBy("split")  # a row a split
    parts = counts.withColumns({"ahead": F.sum("n").over(order) - F.col("n"), "total": F.sum("n").over(Window.partitionBy("var_key"))})
    q = derive_seed(F.lit(seed), F.col("var_key"), F.col("draw").cast("string"), "draw-v1") % F.col("total")
    draws = parts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_var - 1)))).withColumn("pos", (q - F.col("ahead")).cast("int"))
    draws = draws.where((F.col("pos") >= 0) & (F.col("pos") < F.col("n"))).drop("n", "ahead", "total")
    return draws.join(splits, ["var_key", "split", "pos"])


def sample_ids(samples: DataFrame) -> DataFrame:
    """samples (domain, var, file_pos, idx, future_start) -> also sample_id; a repeated id of a variable gets its idx as a suffix.

    Ids are given in file order; rows are then in order of (future_start, idx or 0).
    """
    base = timestamp_id(F.col("domain"), F.col("var"), F.col("future_start"))
    order = Window.partitionBy("domain", "var", "base").orderBy("file_pos")
    rows = samples.withColumn("base", base).withColumn("seen", F.row_number().over(order))
    suffix = F.coalesce(F.col("idx").cast("string"), F.lit("None"))
    return rows.withColumn("sample_id", F.when(F.col("seen") > 1, F.concat(F.col("base"), F.lit("__i"), suffix)).otherwise(F.col("base"))).drop("base", "seen")
