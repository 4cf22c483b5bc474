"""Connected components by contraction, with joins and map-side minima only.

Each round hooks every vertex to its smallest smaller neighbour, halves the hooks' paths until all point to roots, and
renames the edges by the roots; edges inside a component vanish. Rounds and halvings are each logarithmic in practice.
Every table that a later step reads is written to the shared folder, so a lost executor costs one step.
A vertex with very many neighbours is one row after partial minima; the joins' sides are plain tables, so skewed keys can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize


def _jump(hooks: DataFrame) -> DataFrame:
    """(vertex, root) of the forest (vertex, root): every path is followed to its end."""
    last = hooks
    while True:
        up = hooks.select(F.col("vertex").alias("via"), F.col("root").alias("up"))
        new = materialize(hooks.join(up, hooks["root"] == up["via"], "left").select("vertex", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "cc_jump")
        moved = new.where("moved").limit(1).count()
        discard(last)
        last, hooks = new, new.select("vertex", "root")
        if not moved:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b: longs, a > b); the component is its smallest vertex."""
    levels: list[DataFrame] = []
    while True:
        hooks = materialize(edges.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("root")), "cc_hooks")
        if not hooks.limit(1).count():
            break
        roots = _jump(hooks)
        levels.append(roots)
        for end in ("a", "b"):
            named = roots.select(F.col("vertex").alias(f"v_{end}"), F.col("root").alias(f"r_{end}"))
            edges = edges.join(named, F.col(end) == F.col(f"v_{end}"), "left").withColumn(end, F.coalesce(f"r_{end}", end)).drop(f"v_{end}", f"r_{end}")
        edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc_edges")
    if not levels:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    labels = levels[0].select("vertex", F.col("root").alias("component"))
    later = None
    for roots in levels[1:]:
        named = roots.select(F.col("vertex").alias("via"), F.col("root").alias("up"))
        labels = labels.join(named, labels["component"] == named["via"], "left").select("vertex", F.coalesce("up", "component").alias("component"))
        # roots of an earlier round that are hooked later are vertices themselves
        later = roots if later is None else later.unionByName(roots)
    if later is not None:
        known = levels[0].select("vertex")
        extra = later.join(known, "vertex", "left_anti").select("vertex", F.col("root").alias("component"))
        for roots in levels[2:]:
            named = roots.select(F.col("vertex").alias("via"), F.col("root").alias("up"))
            extra = extra.join(named, extra["component"] == named["via"], "left").select("vertex", F.coalesce("up", "component").alias("component"))
        labels = labels.unionByName(extra.dropDuplicates(["vertex"]))
    return materialize(labels, "cc_labels")
