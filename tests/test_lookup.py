"""Streaming JSON, pushed filters, manifests of lines, and spot checks over three sources."""

import io
import json
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import series, spot, windows
from plumbline.sources import files, npz, zipjson
from plumbline.sources.jsonwalk import Walker

json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=12), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=6), json_values, max_size=5), st.integers(1, 9), st.booleans(), st.sampled_from([None, 1]))
def test_walk_is_loads(value, piece, ascii_only, indent):
    raw = json.dumps(value, ensure_ascii=ascii_only, indent=indent).encode("utf-8", "surrogatepass" if ascii_only else "strict") if ascii_only or not any("\ud800" <= c <= "\udfff" for c in json.dumps(value, ensure_ascii=False)) else json.dumps(value).encode()
    walk, got = Walker(io.BytesIO(raw), piece), {}
    for k in walk.keys():
        got[k] = walk.value()
    assert got == value and walk.peek() == ""
    walk = Walker(io.BytesIO(raw), piece)
    assert [k for k in walk.keys() if walk.skip() is None] == list(value)
    if list(value.values()) and isinstance(x := list(value.values())[0], list):
        walk = Walker(io.BytesIO(json.dumps(x).encode()), piece)
        assert [walk.value() for _ in walk.items()] == x


@pytest.mark.parametrize("raw", [b"", b"{", b'{"a"', b'{"a": [1', b'{"a": 1', b'{1: 2}', b'["a"]', b'{"a": "x', b'{"a": "x\\'])
def test_broken_json(raw):
    with pytest.raises(ValueError):
        walk = Walker(io.BytesIO(raw), 2)
        for _ in walk.keys():
            walk.skip()


def archive(path, **members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(f"wrap/{name}.json", text)


def sample(i, past, target="[2]"):
    return f'{{"past_time": {{"timestamp": [], "value": {past}}}, "idx": {i}, "more": [{{"x": "]"}}], "future_time": {{"value": {target}, "timestamp": ["2030-01-0{i}T00:00:00"]}}}}'


def test_values_are_stepped_over(spark, tmp_path):
    archive(tmp_path / "x.zip", a=f'{{"n": 1, "samples": [{sample(1, "[no number]")}, {sample(2, "[1, oops]")}]}}')
    got = zipjson.samples(spark, str(tmp_path / "x.zip"), load_values=False).collect()
    assert [(r["idx"], r["past"], r["target"], str(r["future_start"])[:10]) for r in got] == [(1, None, None, "2030-01-01"), (2, None, None, "2030-01-02")]
    with pytest.raises(Exception, match="Expecting|JSON"):
        zipjson.samples(spark, str(tmp_path / "x.zip")).collect()


def test_members_that_are_not_wanted_are_not_opened(spark, tmp_path):
    archive(tmp_path / "x.zip", a=f'{{"samples": [{sample(1, "[1]")}, {sample(2, "[3]")}]}}', broken="{no json")
    zipjson.register(spark)
    read = lambda **o: spark.read.format("zipjson").options(path=str(tmp_path), **o).load()
    some = read(members='["wrap/a.json", "wrap/zz.json"]')
    assert [(r["idx"], r["past"]) for r in some.collect()] == [(1, [1.0]), (2, [3.0])]
    both = some.where("idx = 2").unionAll(some.where("idx = 1")).unionAll(some)  # uses of one frame do not share a filter
    assert [r["idx"] for r in both.collect()] == [2, 1, 1, 2]
    assert read(members="[]").count() == 0
    with pytest.raises(Exception, match="JSON|Expecting"):
        read().collect()
    assert [tuple(r) for r in read(members='["wrap/a.json"]', idx="[2]", columns="target,member").collect()] == [([2.0], "wrap/a.json")]


def test_arrays_of_other_samples_are_not_decoded():
    text = io.BytesIO(f'{{"samples": [{sample(1, "[1]")}, {sample(3, "[bad]")}]}}'.encode())
    assert [x and x["past"] for x in zipjson._samples(Walker(text), {"past"}, {1})] == [[1.0], None]


def points(spark, n=700, keys=("d__a", "d__b", "e__c")):
    rows = spark.createDataFrame([(k,) for k in keys], "var_key string").join(spark.range(n).select(F.col("id").cast("int").alias("i")))
    return rows.select(F.split("var_key", "__")[0].alias("domain"), "var_key", "i", (F.col("i") * F.col("i") % 97 + F.ascii(F.substring("var_key", 4, 1))).cast("double").alias("v"))


def test_ragged_is_pruned_by_key(spark, tmp_path):
    npz.write_ragged(series.chunks(points(spark), 107, 256), str(tmp_path))
    got = npz.ragged_series(spark, str(tmp_path), ["d__b"], [1]).collect()
    assert len(got) == 1 and len(got[0]["values"]) == 256 + 107
    assert 0 < len(npz.RaggedReader(str(tmp_path), {"d__b"}).partitions()) < len(npz.RaggedReader(str(tmp_path)).partitions())
    np.savez(tmp_path / "other.npz", var_keys=np.array(["d__b"]), series_off=np.array([0]), series_len=np.array([1]), series=np.array([5.0]))
    assert npz.ragged_series(spark, str(tmp_path), ["d__b"]).count() == 4  # a file with another name is looked into
    assert npz.ragged_series(spark, str(tmp_path), []).count() == 0


def test_manifest_of_lines(spark, tmp_path):
    rows = spark.range(25).select(F.lit("d__a").alias("var_key"), F.lit("d").alias("domain"), F.lit(2.5).alias("fallback_std"), F.when(F.col("id") < 20, "train").otherwise("test").alias("split"), F.when(F.col("id") < 20, F.col("id")).otherwise(F.col("id") - 20).alias("pos"), F.concat(F.lit("s"), F.col("id")).alias("sample_id"), (F.col("id") * 4).alias("s"))
    files.write_manifest(rows, str(tmp_path / "m"), ids=7)
    variables, got = files.split_manifest(spark, str(tmp_path / "m"), lines=True)
    assert [tuple(r) for r in variables.collect()] == [("d__a", "d", 2.5)]
    want = sorted(tuple(r) for r in rows.select("var_key", "sample_id", "split", "pos", "s").collect())
    assert sorted(tuple(r) for r in got.select("var_key", "sample_id", "split", "pos", "s").collect()) == want


def test_spot_check_over_three_sources(spark, tmp_path):
    pts = points(spark)
    begins = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("s"))
    cut = windows.cut(pts, 108).withColumns({"n": F.col("s") / 108, "t": begins})
    off = lambda name, key: F.when(F.col("var_key") == key, F.transform(name, lambda x: x + 0.5)).otherwise(F.col(name))
    member = F.concat(F.lit("w/"), F.translate("var_key", "_", ""), F.lit(".json"))
    member = F.concat(F.lit("w/"), "domain", F.lit("/"), F.substring("var_key", 4, 9), F.lit(".json"))
    zipjson.write_windows(cut.select(member.alias("member"), F.col("n").cast("long").alias("n"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("future_start"), off("past", "d__b").alias("past"), "target"), str(tmp_path / "zip"), samples=2)
    ids = cut.select("var_key", "domain", F.lit(1.0).alias("fallback_std"), F.lit("test").alias("split"), F.col("n").cast("long").alias("pos"), F.concat_ws("__", "var_key", F.date_format("t", "yyyyMMdd'T'HHmmss")).alias("sample_id"), "s")
    files.write_manifest(ids.where("var_key <> 'd__a' or s >= 432").where("var_key <> 'e__x'"), str(tmp_path / "m"))
    npz.write_ragged(series.chunks(pts, 107, 256), str(tmp_path / "npz"))
    wanted = {"d__a": "w/d/a.json", "d__b": "w/d/b.json", "e__c": "w/e/c.json", "e__x": "w/e/x.json"}
    got = {r["var_key"]: (r["s"], r["past_diff"], r["target_diff"], r["ok"]) for r in spot.spot_check(spark, wanted, str(tmp_path / "zip"), str(tmp_path / "m"), str(tmp_path / "npz"), 256).collect()}
    assert got == {"d__a": (432, 0.0, 0.0, True), "d__b": (0, 0.5, 0.0, False), "e__c": (0, 0.0, 0.0, True), "e__x": (None, None, None, False)}
    none = spot.spot_check(spark, {"e__x": "w/e/x.json"}, str(tmp_path / "zip"), str(tmp_path / "m"), str(tmp_path / "npz"), 256).collect()
    assert [r["ok"] for r in none] == [False]
