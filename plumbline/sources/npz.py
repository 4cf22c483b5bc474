"""Python data source "npz": columns of NumPy archives as rows.

Options: path (a file, or a folder of .npz files; a path or URI), columns (comma-separated names to read; default all of one length).
Every file is a partition. "ragged" is a second source, of series in a flat array. Two-dimensional arrays become arrays of doubles, scalars are repeated on every row. No pickles.
"""

from __future__ import annotations

import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from plumbline.sources.files import list_files, open_uri, write_bytes


class NpzPart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def _kind(a):
    base = StringType() if a.dtype.kind in "US" else LongType() if a.dtype.kind in "iub" else DoubleType()
    return ArrayType(base) if a.ndim == 2 else base


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.names, self.path = [f.name for f in schema.fields], path

    def partitions(self) -> list[InputPartition]:
        return [NpzPart(f) for f in list_files(self.path) if f.endswith(".npz")]

    def read(self, partition: NpzPart | None) -> Iterator[tuple]:
        import numpy as np

        if partition is None:  # no partitions at all
            return

        with open_uri(partition.value) as f, np.load(f, allow_pickle=False) as z:
            cols = [z[n] for n in self.names]  # each member is read once
        rows = max((len(c) for c in cols if c.ndim), default=1)
        lists = [c.tolist() if c.ndim else [c.item()] * rows for c in cols]
        yield from zip(*lists)


class NpzDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        import numpy as np

        names = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]
        first = next(f for f in list_files(self.options["path"]) if f.endswith(".npz"))
        with open_uri(first) as f, np.load(f, allow_pickle=False) as z:
            return StructType([StructField(n, _kind(z[n])) for n in names or z.files])

    def reader(self, schema: StructType) -> DataSourceReader:
        return NpzReader(schema, self.options["path"])


class RaggedReader(DataSourceReader):
    """Series of caches with one flat value array; ``var_keys`` and ``chunks`` are sets of what is wanted, None for all."""

    def __init__(self, path: str, var_keys: set[str] | None = None, chunks: set[int] | None = None):
        self.path, self.var_keys, self.chunks = path, var_keys, chunks

    def partitions(self) -> list[InputPartition]:
        buckets = None if self.var_keys is None else {_bucket(k) for k in self.var_keys}
        paths = [p for p in list_files(self.path) if p == self.path or p.endswith(".npz")]
        name = re.compile(r".*/b([0-9]{4})-[^/]*\.npz$")
        return [NpzPart(p) for p in paths if buckets is None or not (m := name.match(p)) or int(m[1]) in buckets]

    def read(self, partition: NpzPart | None) -> Iterator[tuple]:
        import numpy as np

        if partition is None:  # no partitions at all
            return

        with open_uri(partition.value) as f, np.load(f, allow_pickle=False) as z:
            keys = [str(k) for k in z["var_keys"].tolist()]
            chunk = z["chunk"].tolist() if "chunk" in z.files else [0] * len(keys)
            mine = [i for i, (k, c) in enumerate(zip(keys, chunk)) if (self.var_keys is None or k in self.var_keys) and (self.chunks is None or c in self.chunks)]
            if not mine:
                return
            off, n, flat = z["series_off"].tolist(), z["series_len"].tolist(), z["series"]
        if not len(keys) == len(off) == len(n) == len(chunk):
            raise ValueError("keys, offsets and lengths differ in number")
        for i in mine:
            yield keys[i], chunk[i], flat[off[i] : off[i] + n[i]].astype(np.float64).tolist()


class RaggedDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ragged"

    def schema(self) -> str:
        return "var_key string, chunk long, `values` array<double>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return RaggedReader(self.options["path"], *(set(json.loads(self.options[k])) if k in self.options else None for k in ("var_keys", "chunks")))


BUCKETS = 64


def _bucket(var_key: str) -> int:
    return zlib.crc32(var_key.encode()) % BUCKETS


def ragged_series(spark: SparkSession, path: str, var_keys: list[str] | None = None, chunks: list[int] | None = None) -> DataFrame:
    """(var_key, chunk, values) of caches with one flat value array and per-series offsets and lengths: a file, or a folder of .npz files.

    Columns of such a file differ in length, so it is read with NumPy, by a task of its own. Files without ``chunk`` hold whole series, as chunk 0.
    With a list of ``var_keys``, files that ``write_ragged`` named for other keys are not opened; of a file's series only those of the wanted keys and
    ``chunks`` become rows. (Lists are given, not pushed down by Spark: see ``zipjson``.)
    """
    register(spark)
    lists = {k: json.dumps(v) for k, v in (("var_keys", var_keys), ("chunks", chunks)) if v is not None}
    return spark.read.format("ragged").options(path=path, **lists).load()


def write_ragged(chunks: DataFrame, folder: str, rows: int = 256) -> None:
    """Write ``chunks`` (var_key, chunk, values) as ragged caches of at most ``rows`` chunks each below ``folder``, by the executors.

    A file's name begins with the bucket of its keys, so that a reader can tell which files hold a key.
    """
    import pyarrow as pa

    def save(batches):
        import numpy as np

        for b in batches:
            dealt: dict[int, list[int]] = {}
            for i, key in enumerate(b.column(0).to_pylist()):
                dealt.setdefault(_bucket(key), []).append(i)
            for bucket, mine in dealt.items():
                for k in range(0, len(mine), rows):
                    keys, chunk, values = (c.to_pylist() for c in b.take(pa.array(mine[k : k + rows])).columns)
                    n, out = np.array([len(v) for v in values], dtype=np.int64), io.BytesIO()
                    flat = np.concatenate([np.array(v, dtype=np.float64) for v in values])
                    np.savez(out, var_keys=np.array(keys), chunk=np.array(chunk, dtype=np.int64), series_off=np.cumsum(n) - n, series_len=n, series=flat)
                    write_bytes(f"{folder}/b{bucket:04d}-{uuid.uuid4().hex}.npz", out.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    chunks.select("var_key", "chunk", "values").mapInArrow(save, "n long").agg({"n": "sum"}).collect()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzDataSource)
    spark.dataSource.register(RaggedDataSource)
