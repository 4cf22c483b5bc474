"""Tensor files: layout, tampering, and one load a worker; states before and after."""

import glob
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import forecast, integrity, state
from plumbline.sources import tensors


def net(layers=50, width=8, seed=0):
    """A stand-in model of a hundred tensors."""
    r = np.random.default_rng(seed)
    out = {}
    for k in range(layers):
        out[f"layers.{k}.weight"] = r.normal(0, 0.3, (width if k else 96, width if k < layers - 1 else 12)).astype(np.float32)
        out[f"layers.{k}.bias"] = r.normal(0, 0.1, out[f"layers.{k}.weight"].shape[1]).astype(np.float32)
    return out


def test_layout(tmp_path):
    own = net() | {"counter": np.array(7, dtype=np.int64), "none": np.zeros((0, 3)), "flags": np.array([True, False])}
    path = str(tmp_path / "w.bin")
    tensors.write(path, own)
    got = tensors.Weights(path)
    assert set(got) == set(own) and len(got) == 103
    for k, v in own.items():
        assert got[k].dtype == v.dtype and got[k].shape == v.shape and np.array_equal(got[k], v)
    with pytest.raises(ValueError):
        got["flags"][0] = False
    raw = (tmp_path / "w.bin").read_bytes()
    n = int.from_bytes(raw[:8], "little")
    head = json.loads(raw[8 : 8 + n])
    assert head["counter"] == {"dtype": "I64", "shape": [], "data_offsets": head["counter"]["data_offsets"]} and len(raw) % 1 == 0
    for bad in (raw[:4], raw[:-5], (1 << 40).to_bytes(8, "little") + raw[8:], b"\x0c" + bytes(7) + b'{"a":1,"a":2}'[:12], raw[:8] + raw[8 : 8 + n].replace(b'"shape": [96, 8]', b'"shape": [96, 9]') + raw[8 + n :]):
        (tmp_path / "bad.bin").write_bytes(bad)
        with pytest.raises((ValueError, KeyError, TypeError)):
            tensors.Weights(str(tmp_path / "bad.bin"))


def test_tampering_is_found(spark, tmp_path):
    own = net()
    tensors.write(f"file://{tmp_path}/a/w.bin", own)
    frozen = tensors.table(spark, str(tmp_path / "a")).select("name", "sha256").toPandas()
    manifest = spark.createDataFrame(frozen)
    assert tensors.require(tensors.against(tensors.table(spark, str(tmp_path / "a/w.bin")), manifest)) == 100
    raw = bytearray((tmp_path / "a/w.bin").read_bytes())
    raw[-3] ^= 1  # one bit of the last tensor
    (tmp_path / "b.bin").write_bytes(raw)
    states = tensors.against(tensors.table(spark, str(tmp_path / "b.bin")), manifest)
    assert [(r["name"], r["state"]) for r in states.where("state <> 'same'").collect()] == [("layers.49.bias", "changed")]
    less = {k: v for k, v in own.items() if k != "layers.3.bias"} | {"extra": np.zeros(1)}
    tensors.write(str(tmp_path / "c.bin"), less)
    with pytest.raises(integrity.ContractError, match=r"layers.3.bias missing, extra unexpected"):
        tensors.require(tensors.against(tensors.table(spark, str(tmp_path / "c.bin")), manifest))
    with pytest.raises(integrity.ContractError, match=r"missing \['layers.3.bias'\], unexpected \['extra'\]"):
        tensors.weights(str(tmp_path / "c.bin"), set(own))


def test_a_worker_loads_once(spark, tmp_path):
    path, marks, names = str(tmp_path / "w.bin"), str(tmp_path), set(net())
    tensors.write(path, net())

    def load():
        fresh = not any(k[0] == path for k in tensors._LOADED)
        w = tensors.weights(path, names)
        if fresh:
            open(f"{marks}/load-{os.getpid()}-{os.urandom(4).hex()}", "w").close()
        open(f"{marks}/task-{os.getpid()}-{os.urandom(4).hex()}", "w").close()

        def model(past, seed):
            x = past
            for k in range(50):
                x = np.tanh(x @ w[f"layers.{k}.weight"] + w[f"layers.{k}.bias"])
            return np.tile(x, (2, 1))

        return model

    rows = spark.range(40).select(F.lit("v").alias("var_key"), F.col("id").cast("string").alias("sample_id"), F.transform(F.sequence(F.lit(1), F.lit(96)), lambda i: F.sin(i + F.col("id"))).alias("past")).repartition(12)
    got = {r["sample_id"]: r["pred"] for r in forecast.with_model(rows, load, (1,), "W").collect()}
    x = np.sin(np.arange(1, 97) + 3.0).astype(np.float32)
    for k in range(50):
        x = np.tanh(x @ net()[f"layers.{k}.weight"] + net()[f"layers.{k}.bias"])
    assert np.allclose(got["3"], x, atol=1e-6)
    pids = [os.path.basename(p).split("-")[1] for p in glob.glob(f"{marks}/load-*")]
    assert len(pids) == len(set(pids)) and len(glob.glob(f"{marks}/task-*")) > len(pids)


def arrays(spark, n=60):
    return spark.range(n).select(F.format_string("m%d/b%d/t%d", F.col("id") % 3, F.col("id") % 7, "id").alias("path"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: i * 0.5 + F.col("id")).alias("values"))


def test_changed_elements_are_named(spark, tmp_path):
    a = arrays(spark)
    one = F.transform("values", lambda x, i: F.when((F.col("path") == "m1/b3/t10") & (i == 42), x + 1e-9).otherwise(x))
    b = a.withColumn("values", one).where("path <> 'm0/b5/t12'").unionByName(spark.createDataFrame([("m9/b0/t0", [1.0])], "path string, values array<double>"))
    trees = [state.save_tree(f, f"{tmp_path}/{k}", 3) for k, f in (("a", a), ("b", b), ("c", a.repartition(5)))]
    leaves, looked = state.differing(trees[0], trees[1], 3)
    got = sorted((r["path"], r["kind"], r["position"]) for r in state.changes(a, b, leaves).collect())
    assert got == [("m0/b5/t12", "removed", None), ("m1/b3/t10", "changed", 42), ("m9/b0/t0", "added", None)]
    assert looked[0] == 1 and looked[1] == 4 and looked[2] == 15 and looked[3] < 12  # other branches were not looked at
    same, looked = state.differing(trees[0], trees[2], 3)
    assert same.count() == 0 and looked == [1]
    # NaN is not equal to itself; lengths that differ are one finding
    c = spark.createDataFrame([("x/y", [1.0, math.nan]), ("x/z", [1.0]), ("short", [2.0])], "path string, values array<double>")
    d = c.withColumn("values", F.when(F.col("path") == "x/z", F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.col("values")))
    leaves, _ = state.differing(state.save_tree(c, f"{tmp_path}/d", 2), state.save_tree(d, f"{tmp_path}/e", 2), 2)
    assert sorted((r["path"], r["kind"], r["position"]) for r in state.changes(c, d, leaves).collect()) == [("x/y", "changed", 1), ("x/z", "changed", None)]
