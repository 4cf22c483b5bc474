"""Files as tables, and report sinks."""

import json
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import report
from plumbline.sources import files, npz, zipjson
from plumbline.streaming import shards


def sample(idx, start, value=1.0):
    s = {"date": "d", "freq": "D", "past_time": {"timestamp": ["2020-01-01T00:00:00"], "value": [value]}, "future_time": {"timestamp": [start, "2031-01-01T00:00:00"], "value": [2]}}
    return s if idx is None else s | {"idx": idx}


def test_zip(spark, tmp_path):
    path = str(tmp_path / "x.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("wrap/g/d/two.json", json.dumps({"samples": [sample(3, "2030-01-02T00:00:00"), sample(1, "2030-01-01T00:00:00"), sample(4, "2030-01-02T00:00:00"), sample(None, "2030-01-02T00:00:00")]}))
        z.writestr("wrap/h/one.json", json.dumps({"samples": [sample(0, "2030-05-01T00:00:00")]}))
        z.writestr("wrap/readme.txt", "no")
    got = zipjson.samples(spark, path).collect()
    assert [(r["grp"], r["domain"], r["var"], r["idx"]) for r in got] == [("g", "d", "two", 1), ("g", "d", "two", None), ("g", "d", "two", 3), ("g", "d", "two", 4), ("h", "h", "one", 0)]
    assert [r["sample_id"][-8:] for r in got[:4]] == ["1T000000", "0__iNone", "2T000000", "0000__i4"]
    assert got[0]["past"] == [1.0] and got[0]["target"] == [2.0] and str(got[0]["future_end"]) == "2031-01-01 00:00:00"
    assert zipjson.samples(spark, path, load_values=False).first()["past"] is None


def test_npz(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    np.savez(path, pred=np.arange(6.0).reshape(2, 3), d=np.array([1.0, 2.0]), ids=np.array(["x", "y"]), seed=np.array(7))
    npz.register(spark)
    got = [tuple(r) for r in spark.read.format("npz").option("path", str(tmp_path)).option("columns", "ids,pred,d,seed").load().orderBy("ids").collect()]
    assert got == [("x", [0.0, 1.0, 2.0], 1.0, 7), ("y", [3.0, 4.0, 5.0], 2.0, 7)]
    np.savez(tmp_path / "c.npz", var_keys=np.array(["p", "q"]), series_off=np.array([0, 2]), series_len=np.array([2, 1]), series=np.array([1.0, 2.0, 3.0]))
    assert {r["var_key"]: r["values"] for r in npz.ragged_series(spark, str(tmp_path / "c.npz")).collect()} == {"p": [1.0, 2.0], "q": [3.0]}


def test_manifest(spark, tmp_path):
    m = {"variables": {"v": {"domain": "d", "fallback_std": 2.0, "sample_start_idx": {"a": 5}, "native": {"train": ["a"], "test": ["b"]}}}}
    (tmp_path / "m.json").write_text(json.dumps(m, indent=1))
    variables, rows = files.split_manifest(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in variables.collect()] == [("v", "d", 2.0)]
    assert sorted(tuple(r) for r in rows.collect()) == [("v", "a", "train", 0, 5), ("v", "b", "test", 0, None)]


def test_hashes(spark, tmp_path):
    (tmp_path / "src/logs").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x")
    (tmp_path / "src/logs/b.py").write_text("y")
    (tmp_path / "src/c.txt").write_text("z")
    got = files.code_fingerprint(spark, str(tmp_path / "src")).collect()
    assert [(r["path"], r["md5"]) for r in got] == [("a.py", files.hash_large(tmp_path / "src/a.py", "md5"))]
    with pytest.raises(FileNotFoundError):
        files.resolve(None, str(tmp_path / "no"))
    assert files.resolve(None, str(tmp_path)) == str(tmp_path)


def test_flatten_and_synthetic(spark):
    assert [tuple(r) for r in files.flatten_numbers(spark, {"a": [1, {"b": 2.5}], "c": None, "t": True}).collect()] == [("/a/0", 1.0), ("/a/1/b", 2.5)]
    got = {r["name"]: r["past"] for r in files.synthetic_windows(spark, [0.5] * 96).collect()}
    assert len(got) == 4 and all(len(p) == 96 for p in got.values()) and got["ramp"][-1] == 47.5


def test_reports(spark, tmp_path):
    report.write_csv(tmp_path / "x.csv", ["a", "b"], [[1, "p,q"]])
    assert (tmp_path / "x.csv").read_bytes() == b'a,b\r\n1,"p,q"\r\n'
    checks = spark.createDataFrame([("A", "x", True, ""), ("A", "y", None, "")], "section string, item string, ok boolean, detail string")
    assert report.write_evidence(checks, tmp_path / "ev") == {"ok": False, "n": 2}
    report.append_jsonl(tmp_path / "l.jsonl", {"k": 1})
    (tmp_path / "pack/predictions").mkdir(parents=True)
    for name in ("predictions/a.npz", "b.npz", "c.py", "d.pyc"):
        (tmp_path / "pack" / name).write_text(name)
    lines = report.audit_pack(tmp_path / "pack", tmp_path / "out.tgz")
    assert [x.split("  ")[1] for x in lines] == ["c.py", "predictions/a.npz"]
    with tarfile.open(tmp_path / "out.tgz") as t:
        assert sorted(t.getnames()) == ["MANIFEST.sha256", "c.py", "predictions/a.npz"]
    report.write_table(checks, str(tmp_path / "t"), "json")
    assert spark.read.json(str(tmp_path / "t")).count() == 2


def test_event_windows_stream(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(tmp_path / "in/a"))
    schema = spark.read.parquet(str(tmp_path / "in/a")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/a"))
    q = shards.event_windows(stream).writeStream.format("memory").queryName("ew").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("ew")
    batch = shards.event_windows(spark.read.parquet(str(tmp_path / "in/a")))
    assert got.count() > 0 and not got.exceptAll(batch).count()  # closed windows are those of the table


def test_commit_batches(spark, tmp_path):
    from plumbline.operators.store import SCHEMA, ShardStore

    rows = spark.createDataFrame([("S", 1, "a__x", f"s{k}", "a", [1.0], [1.0], 1.0) for k in range(4)], "method string, seed int, " + SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    store = ShardStore(spark, f"file://{tmp_path}/shards")
    for _ in range(2):  # the second run finds nothing new
        q = shards.commit_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, {"v": 1}, str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert store.entries("S", [1], ["a-0"]).count() == 4


def test_numbers_of_nested_json(spark):
    text = '{"a": [1, {"b": 2.5, "c": [[]]}], "n": null, "t": true, "s": "3", "o": {}, "e": -1e3, "big": 12345678901234567890}'
    rows = spark.createDataFrame([(1, text), (2, "7"), (3, None), (4, "[]")], "id int, doc string")
    got = sorted((r["id"], r["path"], r["value"]) for r in files.json_numbers(rows, "doc").collect())
    assert got == [(1, "/a/0", 1.0), (1, "/a/1/b", 2.5), (1, "/big", 12345678901234567890.0), (1, "/e", -1000.0), (2, "", 7.0)]
    with pytest.raises(Exception, match="too deeply at /a"):
        files.json_numbers(rows.where("id = 1"), "doc", depth=1).collect()
    with pytest.raises(Exception):
        files.json_numbers(spark.createDataFrame([("{no",)], "doc string"), "doc").collect()


def test_texts_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.txt", 2, "two"), ("a/x.txt", 1, "one"), ("y.txt", 1, "é")], "path string, k int, line string")
    files.write_texts(rows, f"file://{tmp_path}/t")
    assert (tmp_path / "t/a/x.txt").read_text() == "one\ntwo\n" and (tmp_path / "t/y.txt").read_text() == "é\n"
