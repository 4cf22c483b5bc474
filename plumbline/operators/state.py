"""State before and after: a hash tree over nested maps of arrays, of which only branches that differ are compared.

State is a table (path, values): the keys on the way to an array, each after a slash, and the array. Leaves are hashed once, where they lie; every
level above hashes its children's names and hashes, in any order. Two trees are held against each other from the root down: a level looks at
children of nodes that differ, and arrays are compared element by element at leaves that differ only. Equal states cost one look at two roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _multiset(*columns: str) -> Column:
    """An aggregate: hash of rows in any order. Null if a row's hash is."""
    h = F.xxhash64(*columns)
    return F.when(F.count_if(F.col("h").isNull()) == 0, F.xxhash64(F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.count(F.lit(1))))


def save_tree(state: DataFrame, folder: str, depth: int) -> DataFrame:
    """(level, node, h): the hash tree of ``state``, written below ``folder``; level 0 is the root, level ``depth`` has the leaves.

    A leaf that holds a NaN has no hash, and so has nothing above it: it differs from everything, as NaN does. Of several rows of one path all count.
    """
    leaf = F.when(~F.exists("values", lambda x: F.coalesce(F.isnan(x), F.lit(False))), F.xxhash64(F.size("values"), "values"))
    spark = state.sparkSession
    state.select("path", leaf.alias("h")).groupBy(F.col("path").alias("node")).agg(_multiset("h").alias("h")).write.parquet(f"{folder}/level={depth}")
    for k in range(depth - 1, -1, -1):
        below = spark.read.schema("node string, h bigint").parquet(f"{folder}/level={k + 1}")
        parent = F.array_join(F.slice(F.split("node", "/"), 1, k), "/") if k else F.lit("")
        below.select(parent.alias("up"), "node", "h").groupBy("up").agg(_multiset("node", "h").alias("h")).select(F.col("up").alias("node"), "h").write.parquet(f"{folder}/level={k}")
    return spark.read.schema("node string, h bigint, level int").parquet(folder)


def differing(before: DataFrame, after: DataFrame, depth: int) -> tuple[DataFrame, list[int]]:
    """(node, kind) of the leaves of two trees that differ, kind changed, added or removed; and how many nodes of each level were looked at."""
    looked, up = [], None
    for k in range(depth + 1):
        a, b = (t.where(F.col("level") == k).select("node", F.col("h").alias(c), F.lit(True).alias(f"in_{c}")) for t, c in ((before, "x"), (after, "y")))
        if up is not None:
            parent = F.array_join(F.slice(F.split("node", "/"), 1, k - 1), "/") if k > 1 else F.lit("")
            a, b = (f.withColumn("up", parent).join(up, "up", "left_semi").drop("up") for f in (a, b))
        both = a.join(b, "node", "full_outer")
        off = ~F.coalesce(F.col("x") == F.col("y"), F.lit(False))
        kind = F.when(F.col("in_x").isNull(), "added").when(F.col("in_y").isNull(), "removed").otherwise("changed")
        found = both.where(off).select("node", kind.alias("kind"))
        n, differ = both.agg(F.count(F.lit(1)), F.count_if(off)).first()
        looked.append(n)
        up = found.select(F.col("node").alias("up"))
        if not differ:
            break
    return found, looked


def changes(before: DataFrame, after: DataFrame, leaves: DataFrame) -> DataFrame:
    """(path, kind, position, old, new): elements that differ at ``leaves`` (node, kind); a leaf that one side lacks, or whose lengths differ, is one row without position."""
    one = leaves.withColumnsRenamed({"node": "path"})
    a, b = (f.select("path", F.col("values").alias(c)) for f, c in ((before, "x"), (after, "y")))
    rows = one.join(a, "path", "left").join(b, "path", "left")
    cells = F.transform(F.arrays_zip("x", "y"), lambda r, i: F.struct(i.alias("position"), r["x"].alias("old"), r["y"].alias("new")))
    off = F.filter(cells, lambda c: ~F.coalesce((c["old"] == c["new"]) & ~F.isnan(c["old"]), F.lit(False)))
    none = F.array(F.struct(F.lit(None).cast("int").alias("position"), F.lit(None).cast("double").alias("old"), F.lit(None).cast("double").alias("new")))
    whole = (F.col("kind") != "changed") | (F.size("x") != F.size("y"))
    return rows.select("path", "kind", F.explode(F.when(whole, none).otherwise(off)).alias("c")).select("path", "kind", "c.*")
