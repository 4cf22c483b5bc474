"""A whole run with its command line: locked, rejected, planned, run, resumed after a shard is damaged."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import forecast, integrity, windows
from plumbline.plans import evaluate


@pytest.fixture()
def run_dir(spark, tmp_path):
    rows = [(d, f"{d}__{v}", i, float((i * 37 + len(d + v) * 11) % 101)) for d in ("a", "bb") for v in ("x", "yy") for i in range(140)]
    pts = spark.createDataFrame(rows, "domain string, var_key string, i int, v double")
    w = windows.cut(pts, 4).withColumn("d", F.lit(2.0))
    w.write.parquet(f"{tmp_path}/windows")
    forecast.last_value(w).write.parquet(f"{tmp_path}/reference")
    (tmp_path / "frozen.txt").write_text("x")
    config = {
        "windows": f"{tmp_path}/windows", "reference": f"{tmp_path}/reference", "out": f"file://{tmp_path}/out", "method": "S", "seeds": [1, 2],
        "expect": {"windows": w.count(), "variables": 4, "domains": 2}, "files": {f"{tmp_path}/frozen.txt": hashlib.sha256(b"x").hexdigest()},
    }
    (tmp_path / "c.json").write_text(json.dumps(config))
    return tmp_path, config


def test_flags_and_run(spark, run_dir, capsys):
    path, config = run_dir
    file = str(path / "c.json")
    token = hashlib.sha256((path / "c.json").read_bytes()).hexdigest()[:12]
    made = []

    def predict(w, seed):
        made.append((seed, sorted(r[0] for r in w.select("domain").distinct().collect())))
        return evaluate.stand_in(w, seed)

    call = lambda *a: evaluate.main(["--config", file, *a], predict, spark)
    assert call() == 1 and call("--approve", "0" * 12) == 2 and call("--approve", token, "--dry-run") == 2
    capsys.readouterr()
    assert call("--dry-run") == 0 and not made
    assert json.loads(capsys.readouterr().out)["would_run"] == {"windows": 2 * config["expect"]["windows"], "shards": 4, "method": "S"}
    assert call("--approve", token) == 0 and made == [(1, ["a", "bb"]), (2, ["a", "bb"])]
    first = json.loads(capsys.readouterr().out)
    assert set(first["methods_overall"]) == {"N0", "S"} and first["methods_overall"]["N0"]["mse"][1] is None
    assert len(list((path / "out/results").iterdir())) == 6
    # a damaged shard alone is made again, with the same result
    next((path / "out/predictions/method=S/seed=2/domain=bb").glob("data-*/*.parquet")).write_bytes(b"no")
    for crc in (path / "out/predictions/method=S/seed=2/domain=bb").rglob("*.crc"):
        crc.unlink()
    made.clear()
    assert call("--approve", token) == 0 and made == [(2, ["bb"])]
    assert json.loads(capsys.readouterr().out) == first
    assert len(list((path / "out/predictions/quarantine").iterdir())) == 1


def test_a_seed_more_reuses_the_rest_and_changed_code_does_not(spark, run_dir, monkeypatch):
    path, config = run_dir
    made = []

    def predict(w, seed):
        made.append(seed)
        return evaluate.stand_in(w, seed)

    evaluate.run(spark, config | {"seeds": [1]}, predict)
    evaluate.run(spark, config | {"seeds": [1, 2]}, predict)
    assert made == [1, 2] and not (path / "out/predictions/quarantine").exists()
    assert evaluate.ShardStore(spark, f"{config['out']}/predictions").discover() == [("S", s, d) for s in (1, 2) for d in ("a", "bb")]
    monkeypatch.setattr(evaluate, "code_hashes", lambda *f: {"forecast": "changed"})
    evaluate.run(spark, config | {"seeds": [1]}, predict)
    assert made == [1, 2, 1] and len(list((path / "out/predictions/quarantine").iterdir())) == 2


def test_reference_method_is_named(spark):
    one, two = (spark.createDataFrame([(m,) for m in ms], "method string") for ms in (["A"], ["A", "B"]))
    assert evaluate.reference_method({}, one) == "A" and evaluate.reference_method({"reference_method": "B"}, two) == "B"
    for config, rows in (({}, two), ({"reference_method": "C"}, two), ({}, one.limit(0))):
        with pytest.raises(integrity.ContractError):
            evaluate.reference_method(config, rows)


@pytest.mark.parametrize("change,what", [
    ({"expect": {"windows": 1, "variables": 4, "domains": 2}}, "counts"),
    ({"files": {"FROZEN": "0"}}, "files"),
    ({"reference": "WINDOWS"}, None),
])
def test_gate(spark, run_dir, change, what):
    path, config = run_dir
    change = json.loads(json.dumps(change).replace("FROZEN", f"{path}/frozen.txt").replace("WINDOWS", f"{path}/windows"))
    if what is None:
        assert all(r["ok"] for r in evaluate.gate(spark, config | change))
    else:
        with pytest.raises(integrity.ContractError, match=what):
            evaluate.gate(spark, config | change)


def test_totals_by_domain_are_gated(spark, run_dir):
    _, config = run_dir
    each = config["expect"]["windows"] // 2
    want = config["expect"] | {"by_domain": {"a": each, "bb": each}}
    assert [x["item"] for x in evaluate.gate(spark, config | {"expect": want})][1:3] == ["counts", "totals by domain"]
    with pytest.raises(integrity.ContractError, match=r"totals by domain.*'bb': \[\d+, \d+\].*'c': \[0, 5\]"):
        evaluate.gate(spark, config | {"expect": want | {"by_domain": {"a": each, "bb": each + 1, "c": 5}}})
