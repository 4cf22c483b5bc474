"""What the operators share: reading tables, the shared folder, files behind URIs, and shipping the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = "plumbline.checkpoint.dir"
_SHIPPED: set[str] = set()
_WRITTEN: dict[str, None] = {}  # folders of tables, in order


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent.parent
    out = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline_pkg.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset and all runs in one process (tests) one is made."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
    own = spark.conf.get(_OWN_DIR, "")
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
        spark.conf.set(_OWN_DIR, own)
    return own


def new_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/plumbline/{re.sub(r'[^a-z0-9_]', '_', tag.lower())}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write a table to the shared folder, in a folder for each value of ``by``, and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.mode("overwrite").partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = None
    out._plumbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t.__dict__.pop("_plumbline_path", None))


def release(spark: SparkSession) -> int:
    """Delete all tables that ``materialize`` wrote in this process, once no result that rests on them is needed; returns their number."""
    paths = list(_WRITTEN)
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str | None) -> None:
    if path in _WRITTEN:
        del _WRITTEN[path]
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path; local ones need no Hadoop client."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write whole files under another name first: a task that is run twice, or dies, leaves no half file."""
    put = FileWriter(uri)
    put.write(data)
    put.close()


class FileWriter:
    """A stream to ``uri`` that appears under its name only when it is closed."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.path)


def open_input(uri: str):
    fs, path = open_fs(uri)
    return fs.open_input_file(path)


def schema_with(df: DataFrame, more: str):
    """The schema of ``df`` with the columns of a DDL string behind."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def scratch_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    have, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in have:
        k += 1
        name = f"{stem}_{k}"
    return name


def utf8(column) -> list[bytes | None]:
    """An Arrow column of strings as UTF-8 bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def word_groups(column, lower: bool = False, most: int = 4 << 20):
    """(distinct words, place of each word among them, words a text) of an Arrow column of texts, for slices of about ``most`` bytes; null is empty.

    Words are runs without ASCII white space, as UTF-8; with ``lower``, A-Z are lowered. Splitting and telling words apart is Arrow's, so Python
    sees each distinct word of a slice once. A text of any length is in one slice.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.string())
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
        part = column.slice(at, to - at).fill_null("")
        split = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        words, cuts = split.flatten(), split.offsets.to_numpy()
        full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves empty words
        m = np.add.reduceat(full, cuts[:-1] - cuts[0], dtype=np.int64)
        told = words.filter(pa.array(full)).dictionary_encode()
        yield bytes_of(told.dictionary), told.indices.to_numpy(zero_copy_only=False), m
        at = to


def bytes_of(words) -> list[bytes]:
    """An Arrow array of strings without nulls as a list of bytes."""
    import numpy as np

    if not len(words):
        return []
    _, offsets, data = words.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int32, count=len(words) + 1, offset=4 * words.offset).tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def below(o, n: int, total: int):
    """Whether a hash is among the smallest share of all hashes that holds some three times ``n`` of ``total`` rows, or all if they are few."""
    from pyspark.sql import functions as F

    share = 1.0 if total <= 4 * n else 3.0 * n / total
    return F.pmod(o, F.lit(1 << 31)) < F.lit(max(1, round(share * (1 << 31))))


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of (doc_id, o, ...), ranked by the low bits of o; only a few times ``n`` rows are ranked at all, however many there are."""
    from pyspark.sql import functions as F

    return rows.where(below(F.col("o"), n, rows.count())).orderBy(F.pmod("o", F.lit(1 << 31)), "o", "doc_id").limit(n)


def sample_texts(docs: DataFrame, candidates: DataFrame, *extra: str) -> list:
    """Rows (s_o, text, extra...) of ``docs`` for a bounded list of (doc_id, o), o = xxhash64(text, doc_id), in order of o.

    Only ids are ranked and collected first: ranking texts would send every partition's own first rows to the driver.
    """
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    of, by = scratch_name(docs, "s_id"), scratch_name(docs, "s_o")
    few = candidates.select(F.col("doc_id").alias(of), F.col("o").alias(by)).distinct().toArrow()
    if not few.num_rows:
        return []
    same = docs["doc_id"].eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"], docs["doc_id"]) == F.col(by))
    rows = docs.join(F.broadcast(spark.createDataFrame(few)), same).select(F.col(by).alias("s_o"), docs["text"].alias("text"), *[docs[c].alias(c) for c in extra]).distinct().collect()
    return sorted(rows, key=lambda r: (r["s_o"], r["text"] or "", *[str(r[c]) for c in extra]))
