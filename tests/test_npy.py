"""Array files out and in: round trips, ranges, and tasks that fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import npy


def rows(spark, n=1000, width=3):
    return spark.range(n).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.col("id") / k).alias("values"))


def test_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    npy.write(rows(spark).repartitionByRange(4, "i").sortWithinPartitions("i"), folder)
    assert len(list((tmp_path / "out").iterdir())) == 4 and not [p for p in (tmp_path / "out").iterdir() if p.name[0] == "_"]
    back = npy.read(spark, folder, split_rows="100")
    assert back.rdd.getNumPartitions() >= 10
    got = sorted((r["values"] for r in back.collect()))
    assert got == sorted(r["values"] for r in rows(spark).collect())
    whole = np.concatenate([np.load(p) for p in sorted((tmp_path / "out").iterdir())])
    assert whole.shape == (1000, 3) and whole.dtype == np.float64 and (whole[:, 0] == np.arange(1000)).all()
    npy.write(rows(spark, 10), folder)
    assert npy.read(spark, folder).count() == 1010
    npy.write(rows(spark, 7), folder, mode="overwrite", dtype="float32")
    assert npy.read(spark, folder).count() == 7 and np.load(next((tmp_path / "out").iterdir())).dtype == np.float32


def test_single_samples_have_names(spark, tmp_path):
    named = spark.createDataFrame([("revin_a", [1.0, 2.0]), ("revin_b", [3.0])], "name string, values array<double>")
    npy.write(named, str(tmp_path))
    assert np.load(tmp_path / "revin_a.npy").tolist() == [1.0, 2.0] and np.load(tmp_path / "revin_b.npy").tolist() == [3.0]
    assert [(r["file"], r["i"], r["values"]) for r in npy.read(spark, str(tmp_path / "revin_a.npy")).orderBy("i").collect()] == [("revin_a.npy", 0, [1.0]), ("revin_a.npy", 1, [2.0])]
    with pytest.raises(Exception, match="no file name"):
        npy.write(spark.createDataFrame([("../x", [1.0])], named.schema), str(tmp_path / "bad"))


def visible(folder):
    """What readers see; a task that still runs while the job is given up may leave a file in a pending folder."""
    return sorted(p.name for p in folder.iterdir() if p.name[0] != "_") if folder.exists() else []


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "out"
    npy.write(rows(spark, 5), str(folder))
    before = visible(folder)
    broken = rows(spark, 100).repartition(4, "i").withColumn("values", F.when(F.col("i") != 77, F.col("values")))
    with pytest.raises(Exception, match="no values for 77"):
        npy.write(broken, str(folder))
    assert visible(folder) == before
    with pytest.raises(Exception, match="no values for 77"):
        npy.write(broken, str(folder), mode="overwrite")
    assert visible(folder) == before  # what was there stays
    twice = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "name string, values array<double>")
    with pytest.raises(Exception, match="one name"):
        npy.write(twice, str(folder))
    assert visible(folder) == before


def test_what_is_read(spark, tmp_path):
    np.save(tmp_path / "cube.npy", np.arange(24, dtype=np.int16).reshape(2, 3, 4))
    np.save(tmp_path / "_hidden.npy", np.zeros(3))
    np.save(tmp_path / "scalar.npy", np.array(2.5))
    np.save(tmp_path / "none.npy", np.zeros((0, 4)))
    got = {(r["file"], r["i"]): r["values"] for r in npy.read(spark, str(tmp_path)).collect()}
    assert got == {("cube.npy", 0): [float(x) for x in range(12)], ("cube.npy", 1): [float(x) for x in range(12, 24)], ("scalar.npy", 0): [2.5]}
    (tmp_path / "e").mkdir()
    assert npy.read(spark, str(tmp_path / "e")).count() == 0
    raw = (tmp_path / "cube.npy").read_bytes()
    (tmp_path / "e/short.npy").write_bytes(raw[:-3])
    with pytest.raises(Exception, match="ends early"):
        npy.read(spark, str(tmp_path / "e")).collect()
    for bad in (np.array(["x"]), np.asfortranarray(np.zeros((2, 2)))):
        np.save(tmp_path / "e/short.npy", bad)
        with pytest.raises(Exception, match="is not read"):
            npy.read(spark, str(tmp_path / "e")).collect()
