"""Files as tables: hashes, code fingerprints, configs, archived result tables."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(uri: str):
    """(pyarrow filesystem, path) of a URI or a plain path."""
    from pyarrow import fs

    parts = urlparse(uri)
    return (fs.LocalFileSystem(), unquote(parts.path)) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


def open_uri(uri: str):
    """A seekable input file."""
    fs, path = file_system(uri)
    return fs.open_input_file(path)


def list_files(uri: str) -> list[str]:
    """The files of a folder, by name; a file is its own list."""
    from pyarrow import fs as pafs

    fs, path = file_system(uri)
    if fs.get_file_info(path).type != pafs.FileType.Directory:
        return [uri]
    head = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    return sorted(head + i.path for i in fs.get_file_info(pafs.FileSelector(path)) if i.type == pafs.FileType.File)


def write_bytes(uri: str, data: bytes) -> None:
    """Write under another name, then rename: no reader sees half a file."""
    fs, path = file_system(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


MANIFEST_SCHEMA = "variables map<string, struct<domain: string, fallback_std: double, sample_start_idx: map<string, int>, native: map<string, array<string>>, first: map<string, int>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def config(path: str | Path) -> dict:
    return json.loads(Path(path).read_text())


def hash_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256, md5) of the files below a folder, hashed by the executors. Spark reads a file whole: for over 2 GB use hash_large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def hash_large(path: str | Path, kind: str = "sha256", piece: int = 1 << 22) -> str:
    """Hash of a file of any size behind a path or URI, read in pieces."""
    h = hashlib.new(kind)
    with open_uri(str(path)) as f:
        while data := f.read(piece):
            h.update(data)
    return h.hexdigest()


def write_texts(rows: DataFrame, folder: str) -> None:
    """Write rows (path, k, line) as text files below ``folder``, by the executors: a file's lines by k, each with a line feed.

    A file is one group, so paths must bound their lines, such as by a range of k.
    """
    import pyarrow as pa

    def save(key, part):
        lines = [r["line"] for r in sorted(part.select(["k", "line"]).to_pylist(), key=lambda r: r["k"])]
        write_bytes(f"{folder}/{key[0].as_py()}", "".join(f"{x}\n" for x in lines).encode())
        return pa.table({"n": pa.array([len(lines)], pa.int64())})

    rows.select("path", "k", "line").groupBy("path").applyInArrow(save, "n long").agg(F.sum("n")).collect()


def code_fingerprint(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("py", "sh", "yaml"), skip: tuple[str, ...] = ("results", "logs", "predictions", "__pycache__")) -> DataFrame:
    """(path, md5) of source files outside output folders, relative to ``folder``."""
    rows = hash_files(spark, folder, "*.{" + ",".join(suffixes) + "}")
    rel = F.substring_index("path", folder.rstrip("/").split("/")[-1] + "/", -1)
    dirs = F.split(rel, "/")
    return rows.select(rel.alias("path"), "md5").where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in skip]))).orderBy("path")


def resolve(*candidates: str | None, env: str | None = None) -> str:
    """The first that exists of an explicit path, an environment variable's, and defaults."""
    explicit, *defaults = candidates
    for c in (explicit, os.environ.get(env) if env else None, *defaults):
        if c and Path(c).exists():
            return c
    raise FileNotFoundError(f"none of {[c for c in candidates if c]} exists" + (f"; set {env}" if env else ""))


def split_manifest(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(variables, splits) of a nested-map JSON manifest: variables (var_key, domain, fallback_std), splits (var_key, sample_id, split, pos, s).

    The schema is given: inferred, each var_key would become a column. A sample id without a start index has a null s. A manifest is one document,
    read by one task; with ``lines`` it is a folder as ``write_manifest`` makes it, a piece of a variable a line, read by many.
    """
    raw = spark.read.text(path, wholetext=not lines).select(F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    each = raw.select(F.explode("m.variables").alias("var_key", "x"))
    variables = each.select("var_key", "x.domain", "x.fallback_std")
    lists = each.select("var_key", F.col("x.sample_start_idx").alias("starts"), F.col("x.first").alias("first"), F.explode("x.native").alias("split", "ids"))
    # a list with the map's own keys in their order needs no search for each id
    looked = F.transform("ids", lambda k: F.try_element_at("starts", k))
    s = F.when(F.map_keys("starts") == F.col("ids"), F.map_values("starts")).otherwise(looked)
    lists = lists.select("var_key", "split", F.coalesce(F.try_element_at("first", F.col("split")), F.lit(0)).alias("first"), F.arrays_zip(F.col("ids").alias("sample_id"), s.alias("s")).alias("x"))
    rows = lists.select("var_key", "split", "first", F.posexplode("x").alias("at", "x"))
    return variables.distinct() if lines else variables, rows.select("var_key", "x.sample_id", "split", (F.col("at") + F.col("first")).alias("pos"), "x.s")


def write_manifest(rows: DataFrame, folder: str, ids: int = 1 << 12) -> None:
    """Write splits (var_key, domain, fallback_std, split, pos, sample_id, s) as a manifest of lines, each with at most ``ids`` ids of one variable and split.

    Every line is a manifest of its own; ``first`` says where its list begins. Nothing passes through the driver.
    """
    piece = F.floor(F.col("pos") / ids)
    got = F.array_sort(F.collect_list(F.struct("pos", "sample_id", "s")))
    lists = rows.groupBy("var_key", "domain", "fallback_std", "split", piece.alias("piece")).agg(got.alias("x"))
    names = F.transform("x", lambda r: r["sample_id"])
    own = F.struct("domain", "fallback_std", F.map_from_arrays(names, F.transform("x", lambda r: r["s"].cast("int"))).alias("sample_start_idx"), F.create_map("split", names).alias("native"), F.create_map("split", F.element_at("x", 1)["pos"].cast("int")).alias("first"))
    lists.select(F.to_json(F.struct(F.create_map("var_key", own).alias("variables"))).alias("value")).write.text(folder)


def archived_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def json_numbers(rows: DataFrame, json_column: str, depth: int = 8) -> DataFrame:
    """The other columns of ``rows`` with (path, value) for every number within its JSON, for finiteness checks over whole results.

    A path is the keys and positions from the top, each after a slash. Every level of nesting is one narrow step, ``depth`` of them in one scan; a container
    that lies deeper raises, so none is lost. Text, flags and nulls are no numbers; a text that is no JSON raises.
    """
    keep = [c for c in rows.columns if c != json_column]
    level = rows.select(*keep, F.lit("").alias("path"), F.parse_json(json_column).alias("v"))
    for _ in range(depth):  # one scan: containers are opened, all else passes
        inner = level.sparkSession.tvf.variant_explode_outer(F.col("v").outer()).select("pos", "key", F.col("value").alias("w"))
        path = F.concat("path", F.lit("/"), F.coalesce("key", F.col("pos").cast("string")))
        level = level.lateralJoin(inner).select(*keep, F.when(F.col("w").isNull(), F.col("path")).otherwise(path).alias("path"), F.coalesce("w", "v").alias("v"))
    kind = F.schema_of_variant("v")
    deep = F.raise_error(F.concat(F.lit("JSON is nested too deeply at "), F.col("path"))).cast("double")
    value = F.when(kind.rlike("^(OBJECT|ARRAY)") & ~kind.isin("OBJECT<>", "ARRAY<VOID>") | (kind == "ARRAY<VOID>") & F.try_variant_get("v", "$[0]", "variant").isNotNull(), deep)
    value = value.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
    return level.select(*keep, "path", value.alias("value")).where(F.col("value").isNotNull())


def flatten_numbers(spark: SparkSession, obj: object) -> DataFrame:
    """(path, value) of every number in nested dicts and lists, for finiteness checks over a whole result."""
    out: list[tuple[str, float]] = []
    todo: list[tuple[str, object]] = [("", obj)]
    while todo:
        at, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{at}/{k}", v) for k, v in x.items()]
        elif isinstance(x, (list, tuple)):
            todo += [(f"{at}/{k}", v) for k, v in enumerate(x)]
        elif isinstance(x, (int, float)) and not isinstance(x, bool):
            out.append((at, float(x)))
    return spark.createDataFrame(sorted(out, key=lambda r: r[0]), "path string, value double")


def synthetic_windows(spark: SparkSession, noise: list[float], n: int = 96) -> DataFrame:
    """(name, past): constant, ramp, sine, and noise given as literals, since random streams differ between libraries."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    rows = [("constant", F.array_repeat(F.lit(3.5), n)), ("ramp", F.transform(i, lambda x: x * F.lit(0.5))), ("sine", F.transform(i, lambda x: F.sin(x / F.lit(6.0)))), ("noise", F.array(*[F.lit(float(x)) for x in noise[:n]]))]
    one = spark.range(1)
    out = None
    for name, past in rows:
        f = one.select(F.lit(name).alias("name"), past.cast("array<double>").alias("past"))
        out = f if out is None else out.unionByName(f)
    return out


def synthetic_points(noise: DataFrame) -> DataFrame:
    """(chunk, name, i, v): constant, ramp and sine windows, and the given noise, for every row (chunk, i, noise) of a table."""
    i = F.col("i").cast("double")
    kinds = {"constant": F.lit(3.5), "ramp": i * 0.5, "sine": F.sin(i / 6.0), "noise": F.col("noise")}
    return noise.select("chunk", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("v")) for k, v in kinds.items()])).alias("x")).select("chunk", "x.name", "i", "x.v")
