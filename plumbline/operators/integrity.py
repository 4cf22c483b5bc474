"""Contracts: coverage, uniqueness, equality, finiteness and identity, each as a frame of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import all_finite

KEY = ["var_key", "sample_id"]


class ContractError(Exception):
    """A check failed; the message names it and a few keys."""


def same_array(a: Column, b: Column) -> Column:
    """Equal element by element as IEEE numbers: NaN is not NaN, lengths agree."""
    return F.coalesce((F.size(a) == F.size(b)) & (a == b) & ~F.exists(a, lambda x: F.coalesce(F.isnan(x), F.lit(True))), F.lit(False))


def duplicates(entries: DataFrame, key: list[str] = KEY) -> DataFrame:
    return entries.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def missing(entries: DataFrame, expected: DataFrame, key: list[str] = KEY) -> DataFrame:
    return expected.select(*key).join(entries.select(*key), key, "left_anti")


def extra(entries: DataFrame, expected: DataFrame, key: list[str] = KEY) -> DataFrame:
    return entries.select(*key).join(expected.select(*key), key, "left_anti").distinct()


def mismatched(entries: DataFrame, expected: DataFrame, horizon: int, key: list[str] = KEY) -> DataFrame:
    """Entries whose target or d is not bit for bit the expected one."""
    e = expected.select(*key, F.col("target").alias("e_target"), F.col("d").alias("e_d"))
    ok = (F.size("target") == horizon) & same_array(F.col("target"), F.col("e_target")) & (F.col("d") == F.col("e_d")) & ~F.isnan("d")
    return entries.join(e, key).where(~F.coalesce(ok, F.lit(False))).select(*key)


def coverage_report(entries: DataFrame, expected: DataFrame, horizon: int, key: list[str] = KEY) -> DataFrame:
    """(rank, item, bad, ok): row count, uniqueness, key set both ways, values; in the order in which a failure is reported.

    Both sides are computed once and meet in one shuffle by key. Where a key is expected several times, entries are held against one of its rows.
    """
    sides = [f.select(*key, "target", "d", F.lit(x).alias("wanted")) for f, x in ((entries, False), (expected, True))]
    of_key = Window.partitionBy(*key)
    wanted = F.first(F.when(F.col("wanted"), F.struct("target", "d")), ignorenulls=True).over(of_key)
    rows = sides[0].unionByName(sides[1]).withColumn("e", wanted)
    ok = (F.size("target") == horizon) & same_array(F.col("target"), F.col("e.target")) & (F.col("d") == F.col("e.d")) & ~F.isnan("d")
    off = ~F.col("wanted") & F.col("e").isNotNull() & ~F.coalesce(ok, F.lit(False))
    per = rows.groupBy(*key).agg(F.count_if("wanted").alias("m"), F.count_if(~F.col("wanted")).alias("n"), F.count_if(off).alias("off"))
    total = per.agg(
        F.coalesce(F.abs(F.sum("n") - F.sum("m")), F.lit(0)).alias("count"), F.count_if(F.col("n") > 1).alias("duplicates"),
        F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("m"))), F.lit(0)).alias("missing"), F.count_if(F.col("m") == 0).alias("extra"), F.coalesce(F.sum("off"), F.lit(0)).alias("values"),
    )
    items = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(x).alias("item"), F.col(x).cast("long").alias("bad")) for i, x in enumerate(("count", "duplicates", "missing", "extra", "values"))])
    return total.select(F.explode(items).alias("r")).select("r.rank", "r.item", "r.bad", (F.col("r.bad") == 0).alias("ok"))


def verify_coverage(entries: DataFrame, expected: DataFrame, horizon: int, key: list[str] = KEY) -> None:
    """Raise on the first failing item, with up to five keys."""
    for r in coverage_report(entries, expected, horizon, key).orderBy("rank").collect():
        if not r["ok"]:
            find = {"duplicates": lambda: duplicates(entries, key), "missing": lambda: missing(entries, expected, key), "extra": lambda: extra(entries, expected, key), "values": lambda: mismatched(entries, expected, horizon, key)}.get(r["item"])
            some = [tuple(x[k] for k in key) for x in find().orderBy(*key).limit(5).collect()] if find else ""
            raise ContractError(f"coverage: {r['bad']} by {r['item']} {some}".rstrip())


def not_finite(df: DataFrame, *columns: str) -> DataFrame:
    """Rows of which a double column, or an element of an array column, is null, NaN or infinite."""
    from plumbline.functions.scalar import finite

    kinds = dict(df.dtypes)
    ok = reduce(lambda a, b: a & b, [all_finite(F.col(c)) if kinds[c].startswith("array") else finite(F.col(c)) for c in columns])
    return df.where(~ok)


def key_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    left = a.select(key).distinct().withColumn("in_a", F.lit(True))
    right = b.select(key).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, key, "full_outer")
    return both.where("in_a IS NULL OR in_b IS NULL").select(key, F.when(F.col("in_a").isNull(), "only_b").otherwise("only_a").alias("side"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def hashes_match(expected: DataFrame, actual: DataFrame, key: str = "path") -> DataFrame:
    """(key, expected, actual, ok); what is not there is MISSING."""
    e, a = expected.select(key, F.col("sha256").alias("expected")), actual.select(key, F.col("sha256").alias("actual"))
    rows = e.join(a, key, "left").withColumn("actual", F.coalesce("actual", F.lit("MISSING")))
    return rows.withColumn("ok", F.col("expected") == F.col("actual"))


def unique_domain(by_var: DataFrame) -> DataFrame:
    """Variables that more than one domain run brings: merging them would average them silently."""
    return by_var.groupBy("method", "seed", "var_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("n_domains")).where("n > 1")


def merge_checked(by_var: DataFrame, domains: set[str], n_vars: int) -> DataFrame:
    """``by_var`` if each run has just these domains and so many variables, each once; else ContractError."""
    twice = unique_domain(by_var).limit(3).collect()
    if twice:
        raise ContractError(f"variables in several runs: {[r['var_key'] for r in twice]}")
    for r in by_var.groupBy("method", "seed").agg(F.collect_set("domain").alias("d"), F.countDistinct("var_key").alias("n")).collect():
        if set(r["d"]) != domains:
            raise ContractError(f"{r['method']} {r['seed']}: missing {sorted(domains - set(r['d']))[:10]}, extra {sorted(set(r['d']) - domains)[:10]}")
        if r["n"] != n_vars:
            raise ContractError(f"{r['method']} {r['seed']}: {r['n']} variables, not {n_vars}")
    return by_var


def verdict(checks: DataFrame, ok: str = "ok", *by: str) -> DataFrame:
    """(by, all_ok, any_ok, n): all of nothing is true, and null is false."""
    c = F.coalesce(F.col(ok), F.lit(False))
    return checks.groupBy(*by).agg(F.coalesce(F.bool_and(c), F.lit(True)).alias("all_ok"), F.coalesce(F.bool_or(c), F.lit(False)).alias("any_ok"), F.count(F.lit(1)).alias("n"))


def grid_gaps(runs: DataFrame, methods: list[str], seeds: list[int], domains: list[str]) -> DataFrame:
    """Cells of methods x seeds x domains (small, given lists) that no run covers."""
    spark: SparkSession = runs.sparkSession
    grid = spark.createDataFrame([(m, s, d) for m in methods for s in seeds for d in domains], "method string, seed int, domain string")
    return grid.join(runs.select("method", "seed", "domain").distinct(), ["method", "seed", "domain"], "left_anti")


def run_gate(checks: list[tuple[str, callable]]) -> list[dict]:
    """Run named checks in order; a check returns (ok, detail). Stops at the first that fails."""
    out = []
    for name, check in checks:
        ok, detail = check()
        out.append({"item": name, "ok": bool(ok), "detail": detail})
        if not ok:
            raise ContractError(f"{name}: {detail}")
    return out


def same_fingerprint(a: dict, b: dict) -> bool:
    import json

    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)
