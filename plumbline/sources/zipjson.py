"""Python data source "zipjson": variables of ZIPs of JSON files as rows, one a sample, in file order.

Options: path (a file, or a folder of .zip files), load_values (default true; false leaves the values null), columns (comma-separated names to
read; default all). Members are sorted and dealt out as partitions. A variable may go on in the next files by name: file_pos rises along them.

Two more options prune: members (JSON list of names; no other member is opened) and idx (JSON list; of no other sample the arrays are decoded). They
are options, and not filters that Spark pushes down, because Spark 4.1 keeps what a filter left of a Python reader for every later use of the
same frame: two differently filtered uses of one frame would share the first one's rows. Members are read as a stream, a sample at a
time; what no asked column needs is stepped over, so without the values no number of theirs is read.
"""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from plumbline.sources.files import list_files, open_uri, write_bytes
from plumbline.sources.jsonwalk import Walker

SCHEMA = "member string, file_pos long, idx int, date string, freq string, past_ts array<string>, past array<double>, future_ts array<string>, target array<double>"


class Member(InputPartition):
    def __init__(self, path: str, number: int, name: str):
        super().__init__((path, number, name))


class ZipJsonReader(DataSourceReader):
    """``members`` and ``idx``: sets of what is wanted, None for all."""

    def __init__(self, path: str, load_values: bool, names: list[str], members: set[str] | None = None, idx: set[int] | None = None):
        self.path, self.names, self.members, self.idx = path, names, members, idx
        self.wanted = {n for n in names if load_values or n not in ("past", "target")}

    def partitions(self) -> list[InputPartition]:
        out = []
        for number, path in enumerate(list_files(self.path)):
            if path == self.path or path.endswith(".zip"):
                with open_uri(path) as f, zipfile.ZipFile(f) as z:
                    out += [Member(path, number, n) for n in sorted(z.namelist()) if n.endswith(".json") and (self.members is None or n in self.members)]
        return out

    def read(self, partition: Member | None) -> Iterator[tuple]:
        if partition is None:  # no partitions at all
            return
        path, number, name = partition.value
        with open_uri(path) as f, zipfile.ZipFile(f) as z, z.open(name) as text:
            for k, s in enumerate(_samples(Walker(text), self.wanted, self.idx), number << 32):
                if s is not None:
                    s |= {"member": name, "file_pos": k}
                    yield tuple(s.get(n) for n in self.names)


_OF_PART = {"past_time": {"timestamp": "past_ts", "value": "past"}, "future_time": {"timestamp": "future_ts", "value": "target"}}
_ARRAYS = {column for part in _OF_PART.values() for column in part.values()}


def _samples(walk: Walker, wanted: set[str], idx: set[int] | None = None) -> Iterator[dict | None]:
    """The samples of a member as columns; None for one whose idx is not wanted."""
    seen = False
    for key in walk.keys():
        if key != "samples":
            walk.skip()
            continue
        if seen:
            raise ValueError("two lists of samples in a member")
        seen = True
        for _ in walk.items():
            out: dict = {}
            for field in walk.keys():
                if field in _OF_PART:
                    for part in walk.keys():
                        column = _OF_PART[field].get(part)
                        if column in wanted:
                            out[column] = walk.raw()
                        else:
                            walk.skip()
                elif field in wanted or field == "idx":
                    out[field] = walk.value()
                else:
                    walk.skip()
            if idx is not None and out.get("idx") not in idx:
                yield None
                continue
            for column in _ARRAYS & out.keys():
                got = json.loads(out[column])
                out[column] = [float(x) for x in got] if column in ("past", "target") else got
            yield out
    if not seen:
        raise KeyError("samples")


class ZipJsonDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipjson"

    def schema(self) -> str:
        kinds = {part.split()[0]: part for part in SCHEMA.split(", ")}
        names = [n.strip() for n in self.options.get("columns", "").split(",") if n.strip()]
        return ", ".join(kinds[n] for n in names or kinds)

    def reader(self, schema: StructType) -> DataSourceReader:
        members, idx = (set(json.loads(self.options[k])) if k in self.options else None for k in ("members", "idx"))
        return ZipJsonReader(self.options["path"], self.options.get("load_values", "true").lower() != "false", schema.names, members, idx)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipJsonDataSource)


def samples(spark: SparkSession, path: str, load_values: bool = True, members: list[str] | None = None) -> DataFrame:
    """Rows with grp, domain, var, var_key, sample_id, future_start, future_end, in order of (var_key, future_start, idx or 0).

    With ``members``, a short list of names within the archives, no other member is opened.
    """
    from plumbline.functions.scalar import path_group_domain, strip_member, var_key
    from plumbline.operators.splits import sample_ids

    register(spark)
    some = {} if members is None else {"members": json.dumps(members)}
    raw = spark.read.format("zipjson").options(path=path, load_values=str(load_values), **some).load()
    rel = strip_member(F.col("member"))
    parts = F.split(rel, "/")
    where = path_group_domain(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), "/"))
    rows = raw.withColumn("w", where).withColumns({"grp": F.col("w.grp"), "domain": F.col("w.domain"), "var": F.element_at(parts, -1)}).drop("w")
    rows = rows.withColumns({"future_start": F.element_at("future_ts", 1).cast("timestamp_ntz"), "future_end": F.element_at("future_ts", -1).cast("timestamp_ntz"), "var_key": var_key(F.col("domain"), F.col("var"))})
    return sample_ids(rows).orderBy("var_key", "future_start", F.coalesce("idx", F.lit(0)))


def write(rows: DataFrame, folder: str, ids: int = 1 << 14) -> None:
    """Write ``rows`` (kind, idx, t, value; idx unique, from 0) as ZIPs below ``folder``, by the executors: one of each kind and range of ``ids`` ids."""

    def save(key, part):
        kind, chunk = (k.as_py() for k in key)
        samples = []
        for r in sorted(part.to_pylist(), key=lambda r: r["idx"]):
            one = {"timestamp": [r["t"]], "value": [r["value"]]}
            samples.append({"idx": r["idx"], "past_time": one, "future_time": one})
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"wrapper/{kind}/all.json", json.dumps({"samples": samples}))
        write_bytes(f"{folder}/{chunk:012d}-{hashlib.md5(kind.encode()).hexdigest()}.zip", out.getvalue())
        return pa.table({"n": pa.array([len(samples)], pa.int64())})

    dealt = rows.withColumn("chunk", F.floor(F.col("idx") / ids))
    dealt.groupBy("kind", "chunk").applyInArrow(save, "n long").agg(F.sum("n")).collect()


def write_windows(rows: DataFrame, folder: str, samples: int = 1 << 10) -> None:
    """Write windows (member, n, future_start, past, target; n from 0 in each member, in order) as ZIPs below ``folder``, by the executors.

    A member goes on in a further file after every so many samples; the files' names keep their order.
    """

    def save(key, part):
        member, piece = (k.as_py() for k in key)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            body = [{"idx": r["n"], "past_time": {"timestamp": [], "value": r["past"]}, "future_time": {"timestamp": [r["future_start"]], "value": r["target"]}} for r in sorted(part.to_pylist(), key=lambda r: r["n"])]
            z.writestr(member, json.dumps({"name": member, "samples": body}))
        write_bytes(f"{folder}/{piece:012d}-{hashlib.md5(member.encode()).hexdigest()}.zip", out.getvalue())
        return pa.table({"n": pa.array([len(body)], pa.int64())})

    dealt = rows.select("member", "n", "future_start", "past", "target").withColumn("piece", F.floor(F.col("n") / samples))
    dealt.groupBy("member", "piece").applyInArrow(save, "n long").agg(F.sum("n")).collect()
