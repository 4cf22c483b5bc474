"""An evaluation run over windows stored as Parquet: gate, resumable forecasts, coverage, ladder, reports; and its command line.

    python -m plumbline.plans.evaluate --config protocol.json --dry-run
    python -m plumbline.plans.evaluate --config protocol.json --approve <first 12 hex digits of the config's SHA-256>

Config (JSON): windows and reference (Parquet URIs), reference_method (if it holds several), out (URI), method, seeds, expect {windows, variables, domains, by_domain (optional: windows of each)}, files {URI: sha256}.
windows: var_key, sample_id, domain, past, target, d. reference: the same keys with method, seed, pred, target, d.
Exit codes: 0 done or planned, 1 locked (neither approved nor a dry run), 2 rejected.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalar import all_finite, finite
from plumbline.operators import compare, forecast, integrity, metrics, report
from plumbline.operators.store import ShardStore, fingerprint
from plumbline.sources import files

Predict = Callable[[DataFrame, int], DataFrame]


def gate(spark: SparkSession, config: dict) -> list[dict]:
    """Frozen files, counts and keys, in this order; the first failure raises."""
    windows, reference, want = spark.read.parquet(config["windows"]), spark.read.parquet(config["reference"]), config["expect"]

    def hashes():
        got = {uri: files.hash_large(uri) for uri in config.get("files", {})}
        bad = sorted(u for u, h in config.get("files", {}).items() if got[u] != h)
        return not bad, bad

    seen: dict = {}

    def one_pass():
        """Windows, variables and rows that are not finite or not positive of each domain, in one pass; a variable of two domains counts twice."""
        if not seen:
            whole = all_finite(F.col("past")) & all_finite(F.col("target")) & finite(F.col("d")) & (F.col("d") > 0)
            per = windows.groupBy("domain", "var_key").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(whole, F.lit(False))).alias("bad"))
            by_domain = per.groupBy("domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("vars")).collect()  # a row a domain
            seen.update({r["domain"]: (r["n"], r["bad"], r["vars"]) for r in by_domain})
        return seen

    def counts():
        got = one_pass()
        r = {"windows": sum(x[0] for x in got.values()), "variables": sum(x[2] for x in got.values()), "domains": len(got)}
        return r == {k: want[k] for k in r}, r

    def by_domain():
        got, totals = one_pass(), want.get("by_domain", {})
        gaps = {d: [got.get(d, (0,))[0], totals.get(d, 0)] for d in sorted(totals.keys() | got.keys()) if got.get(d, (0,))[0] != totals.get(d, 0)} if totals else {}
        return not gaps, gaps or totals

    def unique():
        some = integrity.duplicates(windows).limit(3).collect()
        return not some, [tuple(r) for r in some]

    def keys():
        return integrity.same_rows(windows.select(*integrity.KEY), reference.select(*integrity.KEY)), "keys of windows and reference"

    def scale():
        n = sum(x[1] for x in one_pass().values())
        return n == 0, n

    return integrity.run_gate([("files", hashes), ("counts", counts), ("totals by domain", by_domain), ("unique keys", unique), ("reference keys", keys), ("finite windows, positive scale", scale)])


#: What says where and how often to run, not what a shard holds: shards made before it changed stay good.
_NOT_IDENTITY = ("seeds", "out")


def code_hashes(*functions: Callable) -> dict[str, str]:
    """MD5 of the sources that make a shard: the package's own modules of forecasts and windows, and the module of each function given."""
    import inspect

    from plumbline.functions import scalar
    from plumbline.operators import windows

    found = {}
    for m in (scalar, forecast, windows, *filter(None, map(inspect.getmodule, functions))):
        try:
            found[m.__name__] = hashlib.md5(inspect.getsource(m).encode()).hexdigest()
        except (OSError, TypeError):  # made in a session: no source to hash
            found[m.__name__] = "no source"
    return found


def shard_mark(config: dict, predict: Predict, seed: int) -> dict:
    """The fingerprint of a run's shards of one seed."""
    return fingerprint({k: v for k, v in config.items() if k not in _NOT_IDENTITY}, code_hashes(predict), method=config["method"], seed=seed)


def reference_method(config: dict, reference: DataFrame) -> str:
    """``reference_method`` of the config; without it, the one method that ``reference`` holds."""
    methods = sorted(r[0] for r in reference.select("method").distinct().limit(10).collect())
    named = config.get("reference_method")
    if named is None and len(methods) != 1:
        raise integrity.ContractError(f"reference holds the methods {methods}: name one as reference_method")
    if named is not None and named not in methods:
        raise integrity.ContractError(f"reference method {named} is not among {methods}")
    return methods[0] if named is None else named


def plan(spark: SparkSession, config: dict) -> dict:
    """What a run would do; no forecast is made."""
    want = config["expect"]
    return {"mode": "dry run", "gate": gate(spark, config), "would_run": {"windows": want["windows"] * len(config["seeds"]), "shards": want["domains"] * len(config["seeds"]), "method": config["method"]}}


def run(spark: SparkSession, config: dict, predict: Predict) -> dict:
    """Forecast what no verified shard holds, check coverage and finiteness of all, aggregate and report. Returns the summary."""
    gate(spark, config)
    windows, reference = spark.read.parquet(config["windows"]), spark.read.parquet(config["reference"])
    method, seeds, ref = config["method"], list(config["seeds"]), reference_method(config, reference)
    horizon = windows.select(F.size("target")).first()[0]
    shards = ShardStore(spark, f"{config['out']}/predictions", horizon)
    domains = sorted(r[0] for r in windows.select("domain").distinct().collect())
    marks = {seed: shard_mark(config, predict, seed) for seed in seeds}
    good = shards.reuse_all(marks, windows, by_seed=True, method=method)  # one job for all shards
    for seed in seeds:
        todo = [d for d in domains if (method, seed, d) not in good]
        if todo:  # one job forecasts all missing shards of a seed
            shards.save_all(predict(windows.where(F.col("domain").isin(todo)), seed).withColumns({"method": F.lit(method), "seed": F.lit(seed)}), marks[seed])
    found = [(s, d) for m, s, d in shards.discover() if m == method and s in seeds and d in domains]
    if len(found) != len(seeds) * len(domains):
        raise integrity.ContractError(f"{len(found)} shards of {method}, not {len(seeds) * len(domains)}")
    for r in shards.verify(marks, windows, by_seed=True, method=method).collect():  # one job: coverage, values and finiteness of all shards
        if r["problems"]:
            raise integrity.ContractError(f"{method} {r['seed']} {r['domain']}: {', '.join(r['problems'])}")
    rows = shards.entries(method, seeds, domains)
    keys = ["method", "seed", "domain", "var_key", "sample_id", "pred", "target", "d"]
    by_var = metrics.variable_level(metrics.score(rows.select(*keys).unionByName(reference.select(*keys))))
    integrity.merge_checked(by_var, set(domains), config["expect"]["variables"])
    return write_reports(by_var, config, method, ref)


def write_reports(by_var: DataFrame, config: dict, method: str, ref: str) -> dict:
    by_var = by_var.persist()
    try:
        by_domain = metrics.domain_level(by_var)
        total = metrics.overall_level(by_domain)
        over = metrics.over_seeds(total)
        tables = {
            "overall": (["method", "seed_stat", "MSE", "MAE"], report.overall_rows(over)),
            "domain_summary": (["method", "domain", "seed_stat", "MSE", "MAE"], report.domain_rows(metrics.over_seeds(by_domain, "domain"))),
            "variable_level": (["method", "var_key", "n_windows", "std_MSE", "std_MAE", "raw_MSE", "raw_MAE"], report.variable_rows(metrics.over_seeds(by_var, "var_key"), by_var)),
            "improvement_counts": (["method", "level", "metric", "improved", "degraded", "equal", "total"], [r for f, k, n in ((by_domain, "domain", "domain"), (by_var, "var_key", "var")) for r in report.improvement_rows(compare.improvement_counts(f, k, ref), n)]),
            "comparisons": (["comparison", "metric", "delta", "relative_improvement"], report.comparison_rows(compare.comparisons(total, [(method, ref)]))),
        }
        for name, (header, rows) in tables.items():
            report.write_csv(f"{config['out']}/results/{name}.csv", header, rows)
        summary = report.summary(over)
        report.write_json(f"{config['out']}/results/aggregate_summary.json", summary)
        return summary
    finally:
        by_var.unpersist()


def stand_in(windows: DataFrame, seed: int) -> DataFrame:
    return forecast.seeded(windows, (seed,), method="S").drop("seed", "method")


def main(argv: list[str] | None = None, predict: Predict = stand_in, spark: SparkSession | None = None) -> int:
    ap = argparse.ArgumentParser(prog="plumbline.plans.evaluate")
    ap.add_argument("--config", required=True)
    ap.add_argument("--seeds", type=int, nargs="*")
    ap.add_argument("--approve")
    ap.add_argument("--dry-run", action="store_true")
    args = ap.parse_args(argv)
    raw = files.open_uri(args.config).read()
    token = hashlib.sha256(raw).hexdigest()[:12]
    if args.approve and (args.dry_run or args.approve != token):
        print("rejected: " + ("a dry run can't be approved" if args.dry_run else "the token is not that of this config"), file=sys.stderr)
        return 2
    if not args.approve and not args.dry_run:
        print("locked: pass --dry-run, or --approve with the config's token", file=sys.stderr)
        return 1
    config = json.loads(raw)
    config["seeds"] = args.seeds or config["seeds"]
    if spark is None:
        from plumbline.session import session

        spark = session()
    print(json.dumps(plan(spark, config) if args.dry_run else run(spark, config, predict), indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
