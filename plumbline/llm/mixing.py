"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document has the key ``-ln(u) / w``: u is uniform, hashed from its id, and w is its quality weight. Within a source,
documents stand in ascending key order; that is weighted sampling without replacement. A source's token target is met by
complete epochs first (every document, ``floor(target / source size)`` times); the rest goes to the first documents by key,
whose prefix sum reaches the rest. The last of them is taken up to the budget.

No source is sorted in one task: keys fall into ``buckets`` ordered ranges a source, whose sums are prefix-summed in a small
table, and only the rows of a bucket meet in a window. At 1e10 rows in a source that is 1e7 rows of four numbers a task.

Defined results: null text has size 0 and takes 0; null source is a source of its own, last; null doc_id hashes as the
empty string; repeated rows count as many documents (equal rows are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

WEIGHTS = (5, 2, 1)
CAP = 3
BUCKETS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> also weight and target. One row a source: this table is small and its windows are global.

    Resharing the excess by weight until none is above its cap ends at min(cap * size, lambda * weight), with the one
    lambda for which the targets add up to all sizes; it is found over the sources in order of cap * size / weight.
    """
    by_point = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = F.array(*[F.lit(float(w)) for w in weights])
    t = sizes.withColumn("weight", F.get(levels, (F.row_number().over(by_point) - 1) % len(weights)))
    t = t.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
    t = t.withColumns({
        "level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(rest),
    })
    t = t.withColumn("lam", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    return t.select("source", "source_size", "weight", F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("lam"), F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, buckets: int = BUCKETS, salt: str = "") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, sample_key, text_hash for each row of ``docs`` (doc_id, text, source).

    Words are counted once: a narrow table of sizes and keys is written, and all that follows reads it.
    """
    text, size = F.coalesce(F.col("text"), F.lit("")), F.col("size")
    point = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double")
    slim = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), ((point + 0.5) / float(16**13)).alias("u"), F.length(text).alias("chars"), F.xxhash64("text").alias("text_hash"))
    mean = F.col("chars") / F.greatest(size, F.lit(1)) - 1
    weight = F.when(size > 0, 1 / (1 + F.abs(F.ln(F.greatest(mean, F.lit(0.5)) / 6)))).otherwise(F.lit(0.05))
    slim = slim.withColumn("sample_key", -F.ln("u") / weight)
    # A monotone map of the key to [0, 1) that is near uniform, as most weights are near 0.8.
    bucket = F.least(F.floor((1 - F.exp(-0.8 * F.col("sample_key"))) * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")
    slim = materialize(slim.select("doc_id", "source", "size", "sample_key", "text_hash", bucket), "mix_sizes")
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, cap)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = sums.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).alias("b")
    t = targets.withColumnRenamed("source", "t_source").alias("t")
    plan = b.join(t, F.col("b.source").eqNullSafe(F.col("t.t_source"))).select(F.col("b.source").alias("p_source"), F.col("bucket").alias("p_bucket"), "ahead", "source_size", "target")
    rows = slim.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    order = Window.partitionBy("source", "bucket").orderBy("sample_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    rows = rows.withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0))).withColumn("epochs", epochs)
    taken = F.col("epochs") * size + F.greatest(F.lit(0), F.least(size, rest - F.col("ahead")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "sample_key", "text_hash")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows: each document as often as the mix takes it, a partly taken one if at least half of it is taken.

    Rows find their counts by id, source and text (its hash); of rows that agree in these all get the largest count.
    """
    plan = mix(docs, **options)
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    plan = plan.select(F.col("doc_id").alias("__pl_id"), F.col("source").alias("__pl_source"), F.col("text_hash").alias("__pl_text"), copies.alias("__pl_copies")).where("__pl_copies > 0")
    plan = plan.groupBy("__pl_id", "__pl_source", "__pl_text").agg(F.max("__pl_copies").alias("__pl_copies"))
    rows = docs.join(plan, docs["doc_id"].eqNullSafe(plan["__pl_id"]) & docs["source"].eqNullSafe(plan["__pl_source"]) & (F.xxhash64(docs["text"]) == plan["__pl_text"]))
    return rows.withColumn("__pl_copy", F.explode(F.sequence(F.lit(1), F.col("__pl_copies")))).drop("__pl_id", "__pl_source", "__pl_text", "__pl_copies", "__pl_copy")


ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, length(coalesce(text, '')) AS chars,
    (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS UBIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN size > 0 THEN 1 / (1 + abs(ln(greatest(chars::DOUBLE / greatest(size, 1) - 1, 0.5) / 6))) ELSE 0.05 END AS sample_key FROM d),
s AS (SELECT source, sum(size)::DOUBLE AS s, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * s / w AS ratio FROM s),
l AS (SELECT a.source, (SELECT sum(s) FROM s) AS total, a.ratio,
    ((SELECT sum(s) FROM s) - coalesce((SELECT sum(3 * b.s) FROM r b WHERE b.ratio < a.ratio), 0)) / (SELECT sum(c.w) FROM r c WHERE c.ratio >= a.ratio) AS level FROM r a),
t AS (SELECT r.source, r.s, least(3 * r.s, r.w * (SELECT max(level) FROM l WHERE level <= ratio)) AS target FROM r),
p AS (SELECT k.doc_id, k.size, t.s, t.target, CASE WHEN t.s > 0 THEN floor(t.target / t.s) ELSE 0 END AS epochs,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.sample_key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target,
    CAST(epochs * size + greatest(0, least(size, round(target - epochs * s) - ahead)) AS BIGINT) AS taken FROM p
"""
