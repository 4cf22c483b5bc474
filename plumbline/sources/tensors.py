"""Frozen weights: tensor files with a JSON header, as tables, against a manifest, and in a model.

Layout of a file, as is public: eight bytes with the header's length (little endian), a JSON header {name: {dtype, shape, data_offsets [from, to]}}, an
optional "__metadata__" among them, and the data, to which the offsets count. Headers are checked: names once, offsets inside the data, sizes
that fit shape and dtype, no overlap.

As a table, files are read by their headers, and every tensor's bytes are hashed by themselves by the executors, a piece at a time. In a model, a
worker maps a local file into memory once, whatever number of tasks it runs; tensors are read-only views of the mapping.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.integrity import ContractError
from plumbline.sources.files import file_system, list_files, open_uri, write_bytes

#: Names that the layout has for kinds of numbers.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}
MOST_HEADER = 100 << 20


def header(f) -> tuple[dict[str, dict], int]:
    """({name: {dtype, shape, data_offsets}}, where the data begins) of an open file."""
    f.seek(0, 2)
    size = f.tell()
    f.seek(0)
    n = int.from_bytes(f.read(8), "little")
    if size < 8 or n > MOST_HEADER or 8 + n > size:
        raise ValueError("tensor file: the header's length is wrong")

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("tensor file: a name stands twice")
        return dict(pairs)

    found = json.loads(f.read(n), object_pairs_hook=once)
    found.pop("__metadata__", None)
    last = 0
    for name, t in sorted(found.items(), key=lambda x: x[1]["data_offsets"]):
        a, b = t["data_offsets"]
        count = 1
        for d in t["shape"]:
            count *= d
        if t["dtype"] not in KINDS or not last <= a <= b <= size - 8 - n or b - a != count * _width(t["dtype"]):
            raise ValueError(f"tensor file: {name} does not fit")
        last = b
    return found, 8 + n


def _width(kind: str) -> int:
    import numpy as np

    return np.dtype(KINDS[kind]).itemsize


def write(uri: str, tensors: Mapping[str, object]) -> None:
    """Write NumPy arrays as one file, under another name first."""
    import numpy as np

    names = {np.dtype(v): k for k, v in KINDS.items()}
    head, data, at = {}, [], 0
    for name, x in tensors.items():
        x = np.asarray(x, order="C")
        head[name] = {"dtype": names[x.dtype.newbyteorder("<") if x.dtype.itemsize > 1 else x.dtype], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        data.append(x.astype(x.dtype.newbyteorder("<"), copy=False).tobytes())
        at += x.nbytes
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    write_bytes(uri, b"".join([len(text).to_bytes(8, "little"), text, *data]))


def table(spark: SparkSession, path: str, piece: int = 1 << 22) -> DataFrame:
    """(file, name, dtype, shape, bytes, sha256) of every tensor of a file, or of a folder's files: a row a tensor, hashed where it lies."""
    import pyarrow as pa

    def heads(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                with open_uri(p) as f:
                    found, begin = header(f)
                rows = [(p, k, t["dtype"], t["shape"], begin + t["data_offsets"][0], t["data_offsets"][1] - t["data_offsets"][0]) for k, t in found.items()]
                cols = list(zip(*rows)) or [[]] * 6
                kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "name", "dtype", "shape", "at", "bytes"])

    def hashes(batches):
        for b in batches:
            out = []
            for p, at, left in zip(*(b.column(i).to_pylist() for i in (0, 4, 5))):
                h = hashlib.sha256()
                with open_uri(p) as f:
                    f.seek(at)
                    while left > 0:
                        data = f.read(min(piece, left))
                        if not data:
                            raise ValueError(f"tensor file: {p} ends early")
                        h.update(data)
                        left -= len(data)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 1, 2, 3, 5)] + [pa.array(out, pa.string())], names=["path", "name", "dtype", "shape", "bytes", "sha256"])

    paths = [(p,) for p in list_files(path)]
    found = spark.createDataFrame(paths, "path string").repartition(max(1, len(paths))).mapInArrow(heads, "path string, name string, dtype string, shape array<long>, at long, bytes long")
    rows = found.repartition("path", "name").mapInArrow(hashes, "path string, name string, dtype string, shape array<long>, bytes long, sha256 string")
    return rows.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "name", "dtype", "shape", "bytes", "sha256")


def against(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, state): same, changed, missing or unexpected, of tensors (name, sha256) held both ways against a frozen manifest (name, sha256).

    A name that several files or manifest rows have is changed, unless all agree.
    """
    side = lambda f, c: f.groupBy("name").agg(F.min("sha256").alias(c), F.max("sha256").alias(f"{c}_max"))
    both = side(found, "got").join(side(manifest, "want"), "name", "full_outer")
    same = (F.col("got") == F.col("want")) & (F.col("got_max") == F.col("want_max"))
    return both.select("name", F.when(F.col("want").isNull(), "unexpected").when(F.col("got").isNull(), "missing").when(same, "same").otherwise("changed").alias("state"))


def require(states: DataFrame) -> int:
    """The number of tensors, if all are the same; else ContractError with counts and a few names."""
    bad = states.where("state <> 'same'")
    counts = {r["state"]: r["n"] for r in bad.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        some = [f"{r['name']} {r['state']}" for r in bad.orderBy("state", "name").limit(10).collect()]
        raise ContractError(f"weights: {counts}: {', '.join(some)}")
    return states.count()


class Weights(Mapping):
    """Tensors of a file by name, read-only. A local file is mapped into memory; another is read once."""

    def __init__(self, uri: str):
        import mmap

        import numpy as np

        fs, path = file_system(uri)
        with open_uri(uri) as f:
            self.found, begin = header(f)
            if type(fs).__name__ == "LocalFileSystem":
                with open(path, "rb") as local:
                    self.data = mmap.mmap(local.fileno(), 0, access=mmap.ACCESS_READ)
            else:
                f.seek(0)
                self.data = f.read()
        self.views = {}
        for name, t in self.found.items():
            x = np.frombuffer(self.data, dtype=KINDS[t["dtype"]], count=(t["data_offsets"][1] - t["data_offsets"][0]) // _width(t["dtype"]), offset=begin + t["data_offsets"][0])
            x.flags.writeable = False
            self.views[name] = x.reshape(t["shape"])

    def __getitem__(self, name: str):
        return self.views[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.views)

    def __len__(self) -> int:
        return len(self.views)


_LOADED: dict[tuple, Weights] = {}


def weights(uri: str, names: set[str] | None = None) -> Weights:
    """The worker's tensors of a file: loaded at first use, and again only if the file's size or time changes. ``names``: what the model has, just these."""
    fs, path = file_system(uri)
    info = fs.get_file_info(path)
    key = uri, info.size, info.mtime_ns
    if key not in _LOADED:
        for old in [k for k in _LOADED if k[0] == uri]:
            del _LOADED[old]
        _LOADED[key] = Weights(uri)
    got = _LOADED[key]
    if names is not None and names != set(got):
        raise ContractError(f"weights: missing {sorted(names - set(got))[:10]}, unexpected {sorted(set(got) - names)[:10]}")
    return got
