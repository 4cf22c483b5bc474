"""Prediction shards: one Parquet directory per (method, seed, domain), a manifest as the only commit point, verified reuse, quarantine.

Layout under the root:  method=M/seed=S/domain=D/{data-<uuid>/, manifest.json}   and   quarantine/<time>-<uuid>-<shard>/
Data is written first under a name of its own; the manifest, which names it and carries fingerprint, row count and content hash, is
renamed into place last. A writer that dies leaves data that no manifest names, and is not read.

A shard's content hash is a hash of its rows as a multiset: two 64-bit hashes of every row, ``pos`` (its place in its variable) included, are summed.
So it does not depend on files, partitions or order of writing, it is an aggregate like the row count, and all shards are written by one
job and counted by one. ``manifests`` is the table of all commit points, and ``verify`` holds it against the data of all shards in one job.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalar import all_finite
from plumbline.operators import integrity

SCHEMA = "var_key string, sample_id string, domain string, pred array<double>, target array<double>, d double"
COLUMNS = ("var_key", "sample_id", "domain", "pred", "target", "d")
SHARD = ("method", "seed", "domain")
#: What a check can find, in the order of its report.
PROBLEMS = ("no data", "fingerprint", "content hash", "row count", "not finite", "duplicates", "missing", "extra", "values")


def content_hash(*columns: str) -> Column:
    """An aggregate: hash of rows as a multiset. Halves of the row hashes are summed as longs, so 2**31 rows fit; more would overflow and say so."""
    sums = []
    for salt in (0, 1):
        h = F.xxhash64(F.lit(salt), *columns)
        sums += [F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.format_string("%016x%016x%016x%016x", *[F.coalesce(s, F.lit(0)) for s in sums])


def canonical(fingerprint: dict) -> str:
    return json.dumps(fingerprint, sort_keys=True)


class ShardStore:
    """Works on any file system that Spark reaches; only manifests and file names pass through the driver."""

    def __init__(self, spark: SparkSession, root: str, horizon: int = 12):
        self.spark, self.root, self.horizon = spark, root.rstrip("/"), horizon
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def shard_dir(self, method: str, seed: int, domain: str) -> str:
        return f"{self.root}/method={method}/seed={seed}/domain={domain}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _read_text(self, path: str) -> str:
        source = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def _write_text(self, path: str, text: str) -> None:
        part = f"{path}.{uuid.uuid4().hex}.part"
        out = self._fs.create(self._path(part), True)
        out.write(bytearray(text.encode()))
        out.close()
        if self._exists(path):
            self._fs.delete(self._path(path), False)
        if not self._fs.rename(self._path(part), self._path(path)):
            raise OSError(f"can't rename {part}")

    def manifest(self, method: str, seed: int, domain: str) -> dict | None:
        path = f"{self.shard_dir(method, seed, domain)}/manifest.json"
        if not self._exists(path):
            return None
        try:
            got = json.loads(self._read_text(path))
        except ValueError:
            return {}
        return got if isinstance(got, dict) else {}

    def _found(self, name: str) -> list:
        return list(self._fs.globStatus(self._path(f"{self.root}/method=*/seed=*/domain=*/{name}")) or [])

    def discover(self) -> list[tuple[str, int, str]]:
        """(method, seed, domain) of every shard below the root that has a manifest, sorted; quarantined ones are not among them."""
        keys = [dict(p.split("=", 1) for p in s.getPath().toString().split("/")[-4:-1]) for s in self._found("manifest.json")]
        return sorted((k["method"], int(k["seed"]), k["domain"]) for k in keys)

    def manifests(self) -> DataFrame:
        """(method, seed, domain, data, n_rows, content, fingerprint): all commit points as a table; what can't be read is null."""
        kind = "method string, seed int, domain string, data string, n_rows bigint, content string, fingerprint string"
        if not self._found("manifest.json"):
            return self.spark.createDataFrame([], kind)
        raw = self.spark.read.option("wholetext", True).text(f"{self.root}/method=*/seed=*/domain=*/manifest.json").select("value", F.col("_metadata.file_path").alias("path"))
        key = [F.regexp_extract("path", rf"/{k}=([^/]*)/", 1).alias(k) for k in SHARD]
        head = F.from_json("value", "data string, n_rows bigint, content_hash string, fingerprint_json string")
        rows = raw.select(key[0], key[1].cast("int"), F.url_decode(key[2]).alias("domain"), head.alias("h"))
        return rows.select(*SHARD, "h.data", "h.n_rows", F.col("h.content_hash").alias("content"), F.col("h.fingerprint_json").alias("fingerprint"))

    def _rows(self) -> DataFrame:
        """Rows of every shard's data, committed or not, with ``data``, the directory they are in. Files that can't be read have no rows."""
        kind = f"{SCHEMA}, pos bigint, method string, seed int"
        if not self._found("data-*"):
            return self.spark.createDataFrame([], f"{kind}, data string")
        rows = self.spark.read.schema(f"{SCHEMA}, pos bigint").option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(f"{self.root}/method=*/seed=*/domain=*/data-*")
        path = F.col("_metadata.file_path")
        of = lambda k: F.regexp_extract(path, rf"/{k}=([^/]*)/", 1)
        return rows.withColumns({"method": of("method"), "seed": of("seed").cast("int"), "data": F.regexp_extract(path, r"/(data-[^/]*)/", 1)})

    def save(self, method: str, seed: int, domain: str, fingerprint: dict, rows: DataFrame) -> dict:
        """Write one shard; ``rows`` has the columns of SCHEMA, and pos if its order is to be kept."""
        return self.save_all(rows.withColumns({"method": F.lit(method), "seed": F.lit(seed)}), fingerprint, domain)[0]

    def save_all(self, preds: DataFrame, fingerprint: dict, domain: str | None = None) -> list[dict]:
        """Write every (method, seed, domain) of ``preds``: one job writes all, one counts what is written, then a manifest each.

        Rows of a shard keep their order: they lie by var_key and ``pos``, where there is one. ``domain`` names the shard of all rows otherwise.
        """
        stage = f"{self.root}/_stage-{uuid.uuid4().hex}"
        named = preds.withColumn("pos", F.col("pos").cast("bigint") if "pos" in preds.columns else F.lit(None).cast("bigint")).withColumn("p_domain", F.col("domain") if domain is None else F.lit(domain))
        keys = ["method", "seed", "p_domain"]
        # a constant drops out of a sort, which the writer then takes for another one and replaces by its own, of the keys only: so keys hang on a column, and none is nullable
        blank = F.left(F.coalesce("var_key", F.lit("")), F.lit(0))
        named = named.withColumns({"method": F.concat(F.coalesce("method", F.lit("")), blank), "seed": F.coalesce("seed", F.lit(0)).cast("int") + F.length(blank), "p_domain": F.concat(F.coalesce("p_domain", F.lit("")), blank)})
        dealt = named.select(*keys, *COLUMNS, "pos").repartitionByRange(*keys, "var_key", "pos").sortWithinPartitions(*keys, "var_key", "pos")
        dealt.write.partitionBy(*keys).parquet(stage)
        written = self.spark.read.schema(f"{SCHEMA}, pos bigint, method string, seed int, p_domain string").parquet(stage)
        out = []
        for r in written.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), content_hash(*COLUMNS, "pos").alias("h")).orderBy(*keys).collect():  # a row a shard
            top, name = self.shard_dir(r["method"], r["seed"], r["p_domain"]), f"data-{uuid.uuid4().hex}"
            self._fs.mkdirs(self._path(top))
            if not self._fs.rename(self._path(f"{stage}/method={r['method']}/seed={r['seed']}/p_domain={r['p_domain']}"), self._path(f"{top}/{name}")):
                raise OSError(f"can't publish {top}")
            head = {"fingerprint": fingerprint, "fingerprint_json": canonical(fingerprint), "data": name, "n_rows": r["n"], "content_hash": r["h"], "shard": f"{r['method']}__{r['p_domain']}__s{r['seed']}"}
            self._write_text(f"{top}/manifest.json", json.dumps(head, sort_keys=True))
            out.append(head)
        self._fs.delete(self._path(stage), True)
        return out

    def verify(self, fingerprint: dict | dict[int, dict], expected: DataFrame | None = None, by_seed: bool = False, method: str | None = None) -> DataFrame:
        """(method, seed, domain, n_rows, problems): every committed shard, its rows, and why it can't be reused (names of PROBLEMS, none if it can).

        One job for all shards: rows are hashed, counted and held against ``expected`` (var_key, sample_id, domain, target, d) in the same aggregates.
        With ``by_seed``, ``fingerprint`` has one for each seed, and shards of other seeds are left alone; with ``method``, those of other methods.
        """
        marks = {k: canonical(v) for k, v in fingerprint.items()} if by_seed else {}
        heads = self.manifests().where((F.col("seed").isin(*marks) if by_seed else F.lit(True)) & (F.col("method") == method if method is not None else F.lit(True)))
        heads = heads.withColumn("wanted", F.coalesce(*[F.when(F.col("seed") == k, F.lit(v)) for k, v in marks.items()], F.lit("" if by_seed else canonical(fingerprint))))
        ids = heads.select(F.col("method").alias("m"), F.col("seed").alias("s"), F.col("domain").alias("shard"), F.col("data").alias("named"))
        rows = self._rows()
        # the shard's own name comes from its path; a row's domain is what is stored
        rows = rows.withColumn("shard", F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"/domain=([^/]*)/", 1))) if self._found("data-*") else rows.withColumn("shard", F.lit(""))
        rows = rows.join(ids, (F.col("data") == F.col("named")) & (F.col("method") == F.col("m")) & (F.col("seed") == F.col("s")) & rows["shard"].eqNullSafe(ids["shard"])).drop(ids["shard"]).drop("m", "s", "named")
        key = ["method", "seed", "shard"]
        found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), content_hash(*COLUMNS, "pos").alias("hash"), F.count_if(~all_finite(F.col("pred"))).alias("not finite"))
        if expected is not None:
            want = ids.join(expected.select(F.col("domain").alias("shard"), *integrity.KEY, "target", "d"), "shard").select(F.col("m").alias("method"), F.col("s").alias("seed"), "shard", *integrity.KEY, "target", "d")
            both = rows.select(*key, *integrity.KEY, F.struct("target", "d").alias("e"), F.lit(None).cast("struct<target:array<double>,d:double>").alias("x"))
            both = both.unionByName(want.select(*key, *integrity.KEY, F.lit(None).cast("struct<target:array<double>,d:double>").alias("e"), F.struct("target", "d").alias("x")))
            per = both.groupBy(*key, *integrity.KEY).agg(F.count("e").alias("n"), F.count("x").alias("m"), F.first("e", ignorenulls=True).alias("e"), F.first("x", ignorenulls=True).alias("x"))
            equal = (F.size("e.target") == self.horizon) & integrity.same_array(F.col("e.target"), F.col("x.target")) & (F.col("e.d") == F.col("x.d")) & ~F.isnan("e.d")
            off = (F.col("n") > 0) & (F.col("m") > 0) & ~F.coalesce(equal, F.lit(False))
            counts = per.groupBy(*key).agg(F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("n") == 0).alias("missing"), F.count_if(F.col("m") == 0).alias("extra"), F.count_if(off).alias("values"))
            found = found.join(counts, key, "full_outer")
        all_ = heads.withColumnRenamed("domain", "shard").join(found, key, "left")
        wrong = {
            "no data": F.col("data").isNull() | F.col("rows").isNull(), "fingerprint": ~F.col("fingerprint").eqNullSafe(F.col("wanted")), "content hash": F.col("hash") != F.col("content"),
            "row count": F.col("rows") != F.col("n_rows"), "not finite": F.col("not finite") > 0,
        } | ({k: F.col(k) > 0 for k in ("duplicates", "missing", "extra", "values")} if expected is not None else {})
        names = F.array_compact(F.array(*[F.when(F.coalesce(wrong[k], F.lit(False)), F.lit(k)) for k in PROBLEMS if k in wrong]))
        return all_.select("method", "seed", F.col("shard").alias("domain"), F.coalesce("rows", F.lit(0)).alias("n_rows"), names.alias("problems"))

    def in_order(self) -> DataFrame:
        """(domain, in_order): whether each variable's rows lie by ``pos`` in every file of each domain's shards, and files follow one another by name."""
        path = F.col("_metadata.file_path")
        rows = self._rows().withColumns({"file": F.regexp_extract(path, r"[^/]*$", 0), "at": F.col("_metadata.row_index"), "chunk": F.floor(F.col("pos") / 4096)})
        # neighbours are compared in chunks of places; the chunks' own first and last rows then stand for them
        of_chunk = Window.partitionBy("method", "seed", "domain", "data", "var_key", "chunk").orderBy("file", "at")
        later = F.coalesce(F.col("pos") > F.lag("pos").over(of_chunk), F.lit(True))
        ends = rows.withColumn("later", later).groupBy("method", "seed", "domain", "data", "var_key", "chunk").agg(F.bool_and("later").alias("ok"), F.min(F.struct("file", "at")).alias("a"), F.max(F.struct("file", "at")).alias("b"))
        of_var = Window.partitionBy("method", "seed", "domain", "data", "var_key").orderBy("chunk")
        apart = F.coalesce(F.col("a") > F.lag("b").over(of_var), F.lit(True))
        return ends.withColumn("ok", F.col("ok") & apart).groupBy("domain").agg(F.bool_and("ok").alias("in_order"))

    def reuse_all(self, fingerprint: dict, expected: DataFrame | None = None, by_seed: bool = False, method: str | None = None) -> set[tuple[str, int, str]]:
        """The stored shards that can stand for a new run; the others that ``verify`` looks at are moved to quarantine."""
        good = set()
        for r in self.verify(fingerprint, expected, by_seed, method).collect():  # a row a shard
            if r["problems"]:
                self.quarantine(r["method"], r["seed"], r["domain"])
            else:
                good.add((r["method"], r["seed"], r["domain"]))
        return good

    def problems(self, method: str, seed: int, domain: str, fingerprint: dict, expected: DataFrame | None = None) -> list[str]:
        """Why the shard can't be reused; empty if it can."""
        rows = self.verify({seed: fingerprint}, expected, True, method).where((F.col("method") == method) & (F.col("seed") == seed) & (F.col("domain") == domain)).collect()
        return list(rows[0]["problems"]) if rows else ["no manifest"]

    def reuse(self, method: str, seed: int, domain: str, fingerprint: dict, expected: DataFrame | None = None) -> bool:
        """Whether the stored shard can stand for a new run; if it is there and can't, it is moved to quarantine."""
        if not self._exists(self.shard_dir(method, seed, domain)):
            return False
        why = self.problems(method, seed, domain, fingerprint, expected)
        if why:
            self.quarantine(method, seed, domain)
        return not why

    def quarantine(self, method: str, seed: int, domain: str) -> str:
        """Move, never delete; names can't collide."""
        stamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
        to = f"{self.root}/quarantine/{stamp}-{uuid.uuid4().hex[:12]}-{method}__{domain}__s{seed}"
        self._fs.mkdirs(self._path(f"{self.root}/quarantine"))
        if not self._fs.rename(self._path(self.shard_dir(method, seed, domain)), self._path(to)):
            raise OSError(f"can't quarantine {method} {seed} {domain}")
        return to

    def quarantined(self) -> list[str]:
        top = f"{self.root}/quarantine"
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(top))) if self._exists(top) else []

    def entries(self, method: str, seeds: list[int], domains: list[str], ordered: bool = False) -> DataFrame:
        """All rows of a method's shards, with method and seed; every shard asked for must have a manifest. With ``ordered``, pos too, and in order."""
        paths = []
        for s in seeds:
            for d in domains:
                head = self.manifest(method, s, d)
                if not head:
                    raise integrity.ContractError(f"no shard {method}__{d}__s{s}")
                paths.append(f"{self.shard_dir(method, s, d)}/{head['data']}")
        rows = self.spark.read.schema(f"{SCHEMA}, pos bigint").parquet(*paths)
        rows = rows.withColumns({"method": F.lit(method), "seed": F.regexp_extract(F.col("_metadata.file_path"), r"/seed=(-?\d+)/", 1).cast("int")})
        return rows.orderBy("seed", "domain", "var_key", "pos") if ordered else rows.drop("pos")


def fingerprint(config: dict, code: dict[str, str], **parts) -> dict:
    """What a shard's identity rests on: hash of the protocol, hashes of the code, and the run's own parameters."""
    return {"protocol_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "code_md5": code, **parts}
