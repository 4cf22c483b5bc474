"""The registered queries over the driver's tables.

Series: ``lineitem.l_extendedprice`` per return flag, line status and line number, by ship date. Windows: 96 points of context and 12 of
target at every fourth start. Methods: N0 repeats the last value, M repeats the context's mean (both single runs), S is the seeded
stand-in with three seeds.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exact, scalar
from plumbline.operators import compare, forecast, integrity, metrics, passing, report, series, splits, spot, state, store, verify, windows
from plumbline.plans.registry import query
from plumbline.sources import files, npy, npz, tensors, zipjson

STRIDE, SEEDS = 4, (2021, 2022, 2023)
PAIRS = [("S", "N0"), ("M", "N0"), ("S", "M")]


def points(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    rows = files.table(spark, sf_dir, "lineitem")
    domain, var = F.concat_ws("_", "l_returnflag", "l_linestatus"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))
    return series.points(rows, domain, var, F.col("l_extendedprice"), ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey"], F.col("l_shipdate"), parts or series.parts_of(rows))


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    pts = points(spark, sf_dir)
    return windows.with_scale(windows.cut(pts, STRIDE), series.fallback_std(pts))


def slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with their scale but without their contexts: last, mean, std and target."""
    parts = series.parts_of(files.table(spark, sf_dir, "lineitem"))
    pts = points(spark, sf_dir, parts)
    return windows.with_scale(windows.summaries(pts, STRIDE, parts=parts), series.fallback_std(pts))


def predictions(w: DataFrame) -> DataFrame:
    """All methods' predictions of each window (as ``slim`` has them): each is given its methods in place."""
    rows = w.withColumn("r", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.lit(s).alias("seed")) for m, s in [("N0", 0), ("M", 0), *[("S", s) for s in SEEDS]]])))
    rows = rows.withColumns({"method": F.col("r.method"), "seed": F.col("r.seed")}).drop("r")
    noise = 0.1 * F.col("d") * (scalar.derive_seed(F.col("seed"), F.col("var_key"), F.col("sample_id")) / 2147483646.0 - 0.5)
    value = F.when(F.col("method") == "N0", F.col("last")).when(F.col("method") == "M", F.col("mean")).otherwise(F.col("last") + F.when(F.col("method") == "S", noise))
    return rows.withColumn("pred", F.array_repeat(value, windows.HORIZON)).drop("last", "mean")


def variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variable_level(metrics.score(predictions(slim(spark, sf_dir))))


# Raw errors are compared in units of 1e6 and 7e3: prices have two decimals, whose means would often stand between two rounded values.
def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def long(*names: str):
    return [F.col(n).cast("long").alias(n) for n in names]


POINTS = """points AS (SELECT l_returnflag || '_' || l_linestatus AS domain, l_returnflag || '_' || l_linestatus || '__line' || l_linenumber AS var_key,
    row_number() OVER (PARTITION BY l_returnflag, l_linestatus, l_linenumber ORDER BY l_shipdate, l_orderkey, l_partkey, l_suppkey) - 1 AS i, l_extendedprice AS v FROM lineitem),
lens AS (SELECT domain, var_key, count(*) AS n FROM points GROUP BY ALL)"""
WINDOWS = POINTS + """,
starts AS (SELECT domain, var_key, var_key || '__' || s AS sample_id, s FROM (SELECT domain, var_key, unnest(range(0, n - 107, 4)) AS s FROM lens WHERE n >= 108)),
cells AS (SELECT a.domain, a.var_key, a.sample_id, a.s, p.i - a.s AS k, p.v FROM starts a JOIN points p ON p.var_key = a.var_key AND p.i BETWEEN a.s AND a.s + 107),
fb AS (SELECT var_key, CASE WHEN stddev_pop(v) < 1e-8 THEN 1.0 ELSE stddev_pop(v) END AS fallback_std FROM points WHERE i < 96 GROUP BY var_key),
stats AS (SELECT domain, var_key, sample_id, s, stddev_pop(v) FILTER (WHERE k < 96) AS sd, avg(v) FILTER (WHERE k < 96) AS m, max(v) FILTER (WHERE k = 95) AS last FROM cells GROUP BY ALL),
scaled AS (SELECT x.*, CASE WHEN isnan(sd) OR sd < 1e-8 THEN fallback_std ELSE sd END AS d FROM stats x JOIN fb USING (var_key))"""
PREDS = WINDOWS + """,
runs AS (SELECT * FROM (VALUES ('N0', 0), ('M', 0), ('S', 2021), ('S', 2022), ('S', 2023)) t(method, seed)),
preds AS (SELECT method, seed, domain, var_key, sample_id, s, d, CASE method WHEN 'N0' THEN last WHEN 'M' THEN m ELSE
    last + 0.1 * d * ((('0x' || substr(sha256('eval-v1|' || seed || '|' || var_key || '|' || sample_id), 1, 16))::UBIGINT % 2147483647)::DOUBLE / 2147483646.0 - 0.5) END AS y FROM scaled, runs)"""
LADDER = PREDS + """,
scored AS (SELECT p.method, p.seed, p.domain, p.var_key, p.sample_id, avg(((y - v) / d) * ((y - v) / d)) AS mse, avg(abs((y - v) / d)) AS mae, avg((y - v) * (y - v)) AS raw_mse, avg(abs(y - v)) AS raw_mae
    FROM preds p JOIN cells c ON c.sample_id = p.sample_id AND c.k >= 96 GROUP BY ALL),
by_var AS (SELECT method, seed, domain, var_key, avg(mse) AS mse, avg(mae) AS mae, avg(raw_mse) AS raw_mse, avg(raw_mae) AS raw_mae, count(*) AS n FROM scored GROUP BY ALL),
by_domain AS (SELECT method, seed, domain, avg(mse) AS mse, avg(mae) AS mae, avg(raw_mse) AS raw_mse, avg(raw_mae) AS raw_mae, count(*) AS n_vars FROM by_var GROUP BY ALL),
overall AS (SELECT method, seed, avg(mse) AS mse, avg(mae) AS mae, avg(raw_mse) AS raw_mse, avg(raw_mae) AS raw_mae, count(*) AS n_domains FROM by_domain GROUP BY ALL)"""


@query(f"WITH {POINTS} SELECT domain, var_key, CAST(i AS BIGINT) AS i, v FROM points")
def series_points(spark, sf_dir):
    return points(spark, sf_dir).select("domain", "var_key", *long("i"), "v")


@query(f"WITH {POINTS} SELECT domain, var_key, CAST(n AS BIGINT) AS n, round(fallback_std, 6) AS fallback_std FROM lens JOIN (SELECT var_key, stddev_pop(v) AS fallback_std FROM points WHERE i < 96 GROUP BY var_key) USING (var_key)")
def series_lengths(spark, sf_dir):
    pts = points(spark, sf_dir)
    return series.lengths(pts).join(series.fallback_std(pts), "var_key").select("domain", "var_key", "n", *r6("fallback_std"))


@query(f"WITH {POINTS} SELECT split_part(var_key, '__', 1) AS domain, var_key, substr(var_key, strpos(var_key, '__') + 2) AS var FROM lens WHERE split_part(var_key, '__', 1) = 'A_F' ORDER BY 1, 2")
def domain_variables(spark, sf_dir):
    rows = series.lengths(points(spark, sf_dir)).select(scalar.domain_of_key(F.col("var_key")).alias("domain"), "var_key", F.split("var_key", "__", 2)[1].alias("var"))
    return rows.where("domain = 'A_F'").orderBy("domain", "var_key")


@query("""SELECT p_type || '/' || p_brand AS path, p_type AS grp, p_brand AS domain, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY ALL
UNION ALL SELECT p_type, p_type, p_type, CAST(count(*) AS BIGINT) FROM part GROUP BY ALL""")
def path_domains(spark, sf_dir):
    part = files.table(spark, sf_dir, "part")
    paths = part.select(F.concat_ws("/", "p_type", "p_brand").alias("path")).unionAll(part.select(F.col("p_type").alias("path")))
    return paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).withColumn("w", scalar.path_group_domain(F.col("path"))).select("path", "w.grp", "w.domain", "n")


@query(f"WITH {WINDOWS} SELECT domain, var_key, sample_id, CAST(s AS BIGINT) AS s FROM starts")
def windows_keys(spark, sf_dir):
    return windows.cut(points(spark, sf_dir), STRIDE).select("domain", "var_key", "sample_id", *long("s"))


@query(f"WITH {WINDOWS} SELECT domain, var_key, sample_id, CAST(k AS BIGINT) AS k, v FROM cells")
def windows_long(spark, sf_dir):
    return windows.long_form(windows.cut(points(spark, sf_dir), STRIDE)).select("domain", "var_key", "sample_id", *long("k"), "v")


@query(f"WITH {WINDOWS} SELECT sample_id, CAST(k AS BIGINT) AS k, v FROM cells WHERE s % 200 = 0")
def windows_at_starts(spark, sf_dir):
    pts = points(spark, sf_dir)
    starts = series.lengths(pts).select("domain", "var_key", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"), F.lit(200))).alias("s"))
    starts = starts.withColumn("sample_id", F.concat_ws("__", "var_key", F.col("s").cast("string")))
    return windows.long_form(windows.cut_at(pts, starts)).select("sample_id", *long("k"), "v")


SPLITS = POINTS + """,
bounds AS (SELECT domain, min(floor(n * 0.7)) AS t_train, min(floor(n * (0.7 + 0.1))) AS t_val FROM lens GROUP BY domain),
st AS (SELECT domain, var_key, unnest(range(0, n - 107, 4)) AS s FROM lens WHERE n >= 108),
sp AS (SELECT st.*, CASE WHEN s + 108 <= t_train THEN 'train' WHEN s + 96 >= t_train AND s + 108 <= t_val THEN 'val' WHEN s + 96 >= t_val THEN 'test' END AS split FROM st JOIN bounds USING (domain)),
native AS (SELECT domain, var_key, var_key || '__' || s AS sample_id, split, row_number() OVER (PARTITION BY var_key, split ORDER BY s) - 1 AS pos, s FROM sp WHERE split IS NOT NULL)"""


def native(spark, sf_dir):
    return splits.native(series.lengths(points(spark, sf_dir)), STRIDE)


@query(f"WITH {SPLITS} SELECT domain, var_key, sample_id, split, CAST(pos AS BIGINT) AS pos, CAST(s AS BIGINT) AS s FROM native")
def splits_native(spark, sf_dir):
    return native(spark, sf_dir).select("domain", "var_key", "sample_id", "split", *long("pos", "s"))


@query(f"""WITH {SPLITS} SELECT sample_id, CAST(s AS BIGINT) AS s, last FROM native JOIN (SELECT var_key AS k, i, v AS last FROM points) p ON p.k = native.var_key AND p.i = native.s + 95 WHERE split = 'test'""")
def test_rows(spark, sf_dir):
    pts = points(spark, sf_dir)
    rows = windows.cut_at(pts, splits.of_split(splits.native(series.lengths(pts), STRIDE), "test").drop("domain", "pos"))
    return rows.select("sample_id", *long("s"), F.element_at("past", -1).alias("last"))


@query(f"""WITH {SPLITS} SELECT var_key, sample_id, split, CAST(pos AS BIGINT) AS pos FROM native WHERE split IN ('train', 'val')
QUALIFY row_number() OVER (PARTITION BY var_key ORDER BY CASE split WHEN 'val' THEN 1 ELSE 2 END, pos) <= 25""")
def trainval_capped(spark, sf_dir):
    return splits.capped(native(spark, sf_dir), 25, ("val", "train")).select("var_key", "sample_id", "split", *long("pos"))


@query(f"""WITH {SPLITS}, dn AS (SELECT domain, var_key, greatest(0, least(n - 107, t_train - 107)) AS dense FROM lens JOIN bounds USING (domain))
SELECT domain, CAST(count(*) AS BIGINT) AS n_vars, CAST(sum(dense) AS BIGINT) AS dense, CAST(ceil(sum(dense) / 32.0) AS BIGINT) AS updates, CAST(ceil(sum(dense) / 32.0) * 32 AS BIGINT) AS samples FROM dn GROUP BY domain""")
def update_counts(spark, sf_dir):
    lens = series.lengths(points(spark, sf_dir))
    n = lens.groupBy("domain").agg(F.count(F.lit(1)).alias("n_vars")).join(splits.dense(lens).groupBy("domain").agg(F.count(F.lit(1)).alias("dense")), "domain", "left")
    n = n.withColumn("dense", F.coalesce("dense", F.lit(0)))
    return n.withColumn("u", scalar.update_counts(F.col("dense"))).select("domain", "n_vars", *long("dense"), "u.updates", "u.samples")


@query(f"""WITH {SPLITS}, nv AS (SELECT var_key, count(*) AS n FROM native GROUP BY var_key),
pool AS (SELECT var_key, sample_id, row_number() OVER (PARTITION BY var_key ORDER BY split, pos) - 1 AS q FROM native),
dr AS (SELECT var_key, k AS draw, ('0x' || substr(sha256('draw-v1|7|' || var_key || '|' || k), 1, 16))::UBIGINT % 2147483647 % n AS q FROM nv, range(0, 8) t(k))
SELECT var_key, CAST(draw AS BIGINT) AS draw, sample_id FROM dr JOIN pool USING (var_key, q)""")
def balanced_sampling(spark, sf_dir):
    return splits.balanced_draws(native(spark, sf_dir), 8, 7).select("var_key", *long("draw"), "sample_id")


@query("""WITH base AS (SELECT *, event_type || '__all__' || strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') AS b, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS seen FROM events)
SELECT event_id, CASE WHEN seen > 1 THEN b || '__i' || event_id ELSE b END AS sample_id FROM base""")
def sample_ids(spark, sf_dir):
    e = files.table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("domain"), F.lit("all").alias("var"), F.col("event_id").alias("file_pos"), F.col("event_id").alias("idx"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("future_start"))
    return splits.sample_ids(rows).select(F.col("idx").alias("event_id"), "sample_id")


@query(f"WITH {WINDOWS} SELECT domain, var_key, sample_id, round(d, 6) AS d FROM scaled")
def window_d(spark, sf_dir):
    return slim(spark, sf_dir).select("domain", "var_key", "sample_id", *r6("d"))


@query(f"""WITH {WINDOWS} SELECT sample_id, CASE WHEN s % 20 = 0 THEN 'constant' WHEN s % 28 = 4 THEN 'nan' WHEN s % 36 = 8 THEN 'tiny' WHEN s % 44 = 12 THEN 'small' ELSE 'own' END AS kind,
    round(CASE WHEN s % 20 = 0 OR s % 28 = 4 OR s % 36 = 8 THEN fallback_std WHEN s % 44 = 12 THEN sd * 1e-6 * 1e6 ELSE sd END, 6) AS d FROM stats JOIN fb USING (var_key)""")
def window_d_fallback(spark, sf_dir):
    """The scale of every window, a part of which is made constant, given a NaN, scaled below the threshold, or small but above it."""
    pts = points(spark, sf_dir)
    s = F.col("s")
    kind = F.when(s % 20 == 0, "constant").when(s % 28 == 4, "nan").when(s % 36 == 8, "tiny").when(s % 44 == 12, "small").otherwise("own")
    made = F.transform("past", lambda x, i: F.when(F.col("kind") == "constant", F.lit(5.0)).when((F.col("kind") == "nan") & (i == 50), F.lit(float("nan"))).when(F.col("kind") == "tiny", x * 1e-14).when(F.col("kind") == "small", x * 1e-6).otherwise(x))
    rows = windows.with_scale(windows.cut(pts, STRIDE).withColumn("kind", kind).withColumn("past", made), series.fallback_std(pts))
    return rows.select("sample_id", "kind", F.round(F.when(F.col("kind") == "small", F.col("d") * 1e6).otherwise(F.col("d")), 6).alias("d"))


@query(f"WITH {PREDS} SELECT CAST(seed AS BIGINT) AS seed, sample_id, CAST(('0x' || substr(sha256('eval-v1|' || seed || '|' || var_key || '|' || sample_id), 1, 16))::UBIGINT % 2147483647 AS BIGINT) AS w FROM preds WHERE method = 'S'")
def seeds_per_window(spark, sf_dir):
    keys = windows.cut(points(spark, sf_dir), STRIDE).select("var_key", "sample_id")
    rows = keys.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    return rows.select(*long("seed"), "sample_id", scalar.derive_seed(F.col("seed"), F.col("var_key"), F.col("sample_id")).alias("w"))


@query(f"WITH {WINDOWS} SELECT sample_id, CAST(h AS BIGINT) AS h, last AS y FROM scaled, range(0, 12) t(h)")
def forecast_last(spark, sf_dir):
    return forecast.last_value(windows.cut(points(spark, sf_dir), STRIDE)).select("sample_id", F.posexplode("pred").alias("h", "y")).select("sample_id", *long("h"), "y")


@query(f"WITH {PREDS} SELECT CAST(seed AS BIGINT) AS seed, sample_id, round(y, 6) AS y FROM preds WHERE method = 'S'")
def forecast_seeded(spark, sf_dir):
    rows = forecast.seeded(slim(spark, sf_dir), SEEDS)
    return rows.select(*long("seed"), "sample_id", F.round(F.element_at("pred", 12), 6).alias("y"))


def _last_model():
    import numpy as np

    return lambda past, seed: np.full((100, 12), past[-1], dtype=np.float32)


@query(f"WITH {WINDOWS} SELECT sample_id, CAST(h AS BIGINT) AS h, round(last::FLOAT::DOUBLE, 3) AS y FROM scaled, range(0, 12) t(h)")
def forecast_pandas_udf(spark, sf_dir):
    rows = forecast.with_model(windows.cut(points(spark, sf_dir), STRIDE), _last_model, (2021,), "U")
    return rows.select("sample_id", F.posexplode("pred").alias("h", "y")).select("sample_id", *long("h"), F.round("y", 3).alias("y"))


@query("SELECT CAST(label AS BIGINT) AS label, CAST(h - 1 AS BIGINT) AS h, round(avg(x::DOUBLE), 6) AS y FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS h FROM embeddings) GROUP BY ALL")
def draw_mean(spark, sf_dir):
    got = forecast.draw_mean(files.table(spark, sf_dir, "embeddings"), "label", "embedding")
    return got.select(*long("label", "h"), *r6("y"))


@query(f"WITH {WINDOWS} SELECT domain, CAST(count(*) AS BIGINT) AS n, round(avg(m), 4) AS mean, round(avg(sd + 1e-5), 4) AS std, true AS ok FROM scaled GROUP BY domain")
def revin_roundtrip(spark, sf_dir):
    rows = windows.cut(points(spark, sf_dir), STRIDE).withColumn("n", scalar.revin_normalise(F.col("past")))
    back = scalar.revin_inverse(F.col("n.z"), F.col("n.mean"), F.col("n.std"))
    off = F.array_max(F.zip_with(back, F.col("past"), lambda a, b: F.abs(a - b) / F.greatest(F.abs(b), F.lit(1e-12))))
    rows = rows.select("domain", "n.mean", "n.std", off.alias("off"))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mean"), 4).alias("mean"), F.round(F.avg("std"), 4).alias("std"), (F.max("off") < 1e-9).alias("ok"))


@query(f"WITH {LADDER} SELECT sample_id, round(mse, 6) AS mse, round(mae, 6) AS mae, round(raw_mse / 1e6, 6) AS raw_mse, round(raw_mae / 7e3, 7) AS raw_mae FROM scored WHERE method = 'N0'")
def window_metrics(spark, sf_dir):
    rows = metrics.score(forecast.last_value(slim(spark, sf_dir)))
    return rows.select("sample_id", *r6("mse", "mae"), F.round(F.col("raw_mse") / 1e6, 6).alias("raw_mse"), F.round(F.col("raw_mae") / 7e3, 7).alias("raw_mae"))


_M = ["round(mse, 6) AS mse", "round(mae, 6) AS mae", "round(raw_mse / 1e6, 6) AS raw_mse", "round(raw_mae / 7e3, 7) AS raw_mae"]


def _m():
    return [*r6("mse", "mae"), F.round(F.col("raw_mse") / 1e6, 6).alias("raw_mse"), F.round(F.col("raw_mae") / 7e3, 7).alias("raw_mae")]


@query(f"WITH {LADDER} SELECT method, CAST(seed AS BIGINT) AS seed, domain, var_key, CAST(n AS BIGINT) AS n, {', '.join(_M)} FROM by_var")
def variable_level(spark, sf_dir):
    return variables(spark, sf_dir).select("method", *long("seed"), "domain", "var_key", "n", *_m())


@query(f"WITH {LADDER} SELECT method, CAST(seed AS BIGINT) AS seed, domain, CAST(n_vars AS BIGINT) AS n_vars, {', '.join(_M)} FROM by_domain")
def domain_summary(spark, sf_dir):
    return metrics.domain_level(variables(spark, sf_dir)).select("method", *long("seed"), "domain", "n_vars", *_m())


@query(f"WITH {LADDER} SELECT method, CAST(n_domains AS BIGINT) AS n_domains, {', '.join(_M)} FROM overall WHERE method = 'N0'")
def overall(spark, sf_dir):
    by_var = metrics.variable_level(metrics.score(forecast.last_value(slim(spark, sf_dir))))
    return metrics.overall_level(metrics.domain_level(by_var)).select("method", "n_domains", *_m())


_CELLS = " UNION ALL ".join(f"SELECT '{name}' AS level, CAST(4 * count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS unequal FROM {level}" for name, level in (("variable", "by_var"), ("domain", "by_domain"), ("overall", "overall")))


@query(f"WITH {LADDER} {_CELLS}")
def ladder_bit_equal(spark, sf_dir):
    """The whole ladder of all methods on three layouts of the same scored windows: no cell may differ in a bit."""
    scored = _kept(metrics.score(predictions(slim(spark, sf_dir))).select("method", "seed", "domain", "var_key", *metrics.METRICS), "scored")  # scored once, dealt three ways
    return metrics.bit_equal(scored, keep=lambda by_var: _kept(by_var, "layout"))


@query(f"WITH {WINDOWS} SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS same FROM starts GROUP BY domain")
def window_moments(spark, sf_dir):
    """Last value, mean, deviation and target of every window, merged from running moments, against folds over its own values."""
    pts = points(spark, sf_dir)
    whole = windows.cut(pts, STRIDE).select("sample_id", F.col("target").alias("t"), F.element_at("past", -1).alias("l"), scalar.array_mean(F.col("past")).alias("m"), scalar.array_pstd(F.col("past")).alias("sd"))
    rows = windows.summaries(pts, STRIDE).join(whole, "sample_id")
    same = (F.col("target") == F.col("t")) & (F.col("last") == F.col("l")) & scalar.within(F.col("mean"), F.col("m"), rtol=1e-12) & scalar.within(F.col("std"), F.col("sd"), rtol=1e-12)
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same"))


#: Queries that need no context: their plans carry no slice of it.
QUERIES_OF_WINDOWS = (window_d, window_metrics, overall, variable_level)


def _seed_sql(level: str, keys: str) -> str:
    stats = ", ".join(f"round(avg({m}){s}, 6) AS {m}_mean, round(stddev_samp({m}){s}, 6) AS {m}_std" for m, s in (("mse", ""), ("mae", ""), ("raw_mse", " / 1e6"), ("raw_mae", " / 7e3")))
    return f"WITH {LADDER} SELECT method, {keys}{stats}, CAST(count(*) AS BIGINT) AS n_seeds FROM {level} GROUP BY ALL"


def _seed_columns(df: DataFrame, *keys: str) -> DataFrame:
    scale = {"mse": 1, "mae": 1, "raw_mse": 1e6, "raw_mae": 7e3}
    return df.select("method", *keys, *[F.round(F.col(f"{m}_{x}") / s, 6).alias(f"{m}_{x}") for m, s in scale.items() for x in ("mean", "std")], "n_seeds")


@query(_seed_sql("overall", ""))
def overall_seed_stats(spark, sf_dir):
    return _seed_columns(metrics.over_seeds(metrics.overall_level(metrics.domain_level(variables(spark, sf_dir)))))


@query(_seed_sql("by_domain", "domain, "))
def domain_seed_stats(spark, sf_dir):
    return _seed_columns(metrics.over_seeds(metrics.domain_level(variables(spark, sf_dir)), "domain"), "domain")


@query(_seed_sql("by_var", "domain, var_key, "))
def variable_seed_stats(spark, sf_dir):
    return _seed_columns(metrics.over_seeds(variables(spark, sf_dir), "domain", "var_key"), "domain", "var_key")


def _counts_sql(level: str, key: str, name: str) -> str:
    one = " UNION ALL ".join(f"SELECT method, {key} AS k, '{m}' AS metric, avg({m}) AS x FROM {level} GROUP BY ALL" for m in ("mse", "mae"))
    return f"""SELECT a.method, '{name}' AS level, a.metric, CAST(count(*) FILTER (WHERE a.x < b.x) AS BIGINT) AS improved, CAST(count(*) FILTER (WHERE a.x > b.x) AS BIGINT) AS degraded,
        CAST(count(*) FILTER (WHERE a.x = b.x) AS BIGINT) AS equal, CAST(count(*) AS BIGINT) AS total FROM ({one}) a JOIN ({one}) b ON a.k = b.k AND a.metric = b.metric AND b.method = 'N0' WHERE a.method <> 'N0' GROUP BY ALL"""


@query(f"WITH {LADDER} {_counts_sql('by_domain', 'domain', 'domain')} UNION ALL {_counts_sql('by_var', 'var_key', 'var')}")
def improvement_counts(spark, sf_dir):
    by_var = variables(spark, sf_dir)
    parts = [compare.improvement_counts(f, key, "N0").withColumn("level", F.lit(name)) for f, key, name in ((metrics.domain_level(by_var), "domain", "domain"), (by_var, "var_key", "var"))]
    return parts[0].unionByName(parts[1]).select("method", "level", "metric", "improved", "degraded", "equal", "total")


_COMPARE = f"""WITH {LADDER}, mm AS (SELECT method, 'mse' AS metric, avg(mse) AS x FROM overall GROUP BY method UNION ALL SELECT method, 'mae', avg(mae) FROM overall GROUP BY method)
SELECT a.method || '-' || b.method AS comparison, a.metric, round(a.x - b.x, 6) AS delta, round(CASE WHEN b.x <> 0 THEN -(a.x - b.x) / b.x * 100 END, 6) AS relative_improvement
FROM (VALUES ('S', 'N0'), ('M', 'N0'), ('S', 'M')) t(p, q) JOIN mm a ON a.method = p JOIN mm b ON b.method = q AND b.metric = a.metric"""


@query(_COMPARE)
def comparisons(spark, sf_dir):
    got = compare.comparisons(metrics.overall_level(metrics.domain_level(variables(spark, sf_dir))), PAIRS)
    return got.select("comparison", "metric", *r6("delta", "relative_improvement"))


def selection(by_domain: DataFrame) -> DataFrame:
    """A made-up selection record: a run falls back where seed and the domain's first letter's code add up to a multiple of three."""
    return by_domain.where("method = 'S'").select("method", "seed", "domain", ((F.col("seed") + F.ascii("domain")) % 3 == 0).alias("fallback"))


@query(f"""WITH {LADDER}, sel AS (SELECT method, seed, domain, (seed + ascii(domain)) % 3 = 0 AS fallback FROM by_domain WHERE method = 'S'),
pick AS (SELECT sel.method, sel.seed, fallback, CASE WHEN fallback THEN n.mse ELSE o.mse END AS mse, CASE WHEN fallback THEN n.mae ELSE o.mae END AS mae
    FROM sel JOIN by_domain o ON o.method = sel.method AND o.seed = sel.seed AND o.domain = sel.domain JOIN by_domain n ON n.method = 'N0' AND n.domain = sel.domain)
SELECT method, CAST(seed AS BIGINT) AS seed, round(avg(mse), 6) AS overall_mse, round(avg(mae), 6) AS overall_mae, CAST(count(*) FILTER (WHERE fallback) AS BIGINT) AS n_fallback, CAST(count(*) AS BIGINT) AS n_domains FROM pick GROUP BY ALL""")
def fallback_summary(spark, sf_dir):
    by_domain = metrics.domain_level(_kept(variables(spark, sf_dir), "variables"))  # three sides of joins read it: the windows are scored once
    got = compare.with_fallback(by_domain, selection(by_domain), "N0")
    return got.select("method", *long("seed"), *r6("overall_mse", "overall_mae"), "n_fallback", "n_domains")


@query("""WITH curve AS (SELECT event_type AS run, user_id % 20 AS epoch, round(avg(value), 1) AS val_mse FROM events GROUP BY ALL), best AS (SELECT run, min(val_mse) AS b FROM curve GROUP BY run)
SELECT run, CAST(min(epoch) AS BIGINT) AS epoch, arg_min(val_mse, epoch) AS val_mse FROM curve JOIN best USING (run) WHERE val_mse <= b + 0.3 GROUP BY run""")
def best_epoch(spark, sf_dir):
    curve = files.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), (F.col("user_id") % 20).alias("epoch")).agg(F.round(F.avg("value"), 1).alias("val_mse"))
    return compare.best_epoch(curve, tolerance=0.3).select("run", *long("epoch"), "val_mse")


def faulty(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Entries with planted faults, and what is expected of them."""
    w = slim(spark, sf_dir).select("var_key", "sample_id", "s", "target", "d")
    entries = w.where("s % 40 <> 0").withColumn("sample_id", F.when(F.col("s") % 44 == 4, F.concat("sample_id", F.lit("x"))).otherwise(F.col("sample_id")))
    entries = entries.withColumn("d", F.when(F.col("s") % 52 == 8, F.col("d") * (1 + 1e-12)).otherwise(F.col("d")))
    entries = entries.unionByName(entries.where("s % 60 = 24"))
    return entries, w


FAULTS = WINDOWS + """,
kept AS (SELECT var_key, CASE WHEN s % 44 = 4 THEN sample_id || 'x' ELSE sample_id END AS sample_id, s FROM starts WHERE s % 40 <> 0),
entries AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE s % 60 = 24)"""


@query(f"""WITH {FAULTS} SELECT var_key, sample_id, 'missing' AS side FROM starts WHERE sample_id NOT IN (SELECT sample_id FROM entries)
UNION ALL SELECT DISTINCT var_key, sample_id, 'extra' FROM entries WHERE sample_id NOT IN (SELECT sample_id FROM starts)""")
def coverage_missing_extra(spark, sf_dir):
    entries, w = faulty(spark, sf_dir)
    parts = [f(entries, w).withColumn("side", F.lit(name)) for name, f in (("missing", integrity.missing), ("extra", integrity.extra))]
    return parts[0].unionByName(parts[1])


@query(f"WITH {FAULTS} SELECT var_key, sample_id, CAST(count(*) AS BIGINT) AS n FROM entries GROUP BY ALL HAVING count(*) > 1")
def coverage_duplicates(spark, sf_dir):
    return integrity.duplicates(faulty(spark, sf_dir)[0])


@query(f"WITH {FAULTS} SELECT var_key, sample_id FROM entries WHERE s % 52 = 8 AND sample_id IN (SELECT sample_id FROM starts)")
def coverage_value_mismatch(spark, sf_dir):
    return integrity.mismatched(*faulty(spark, sf_dir), windows.HORIZON)


@query(f"""WITH {FAULTS}, bad AS (SELECT 0 AS rank, 'count' AS item, abs((SELECT count(*) FROM entries) - (SELECT count(*) FROM starts)) AS bad
UNION ALL SELECT 1, 'duplicates', (SELECT count(*) FROM (SELECT sample_id FROM entries GROUP BY sample_id HAVING count(*) > 1))
UNION ALL SELECT 2, 'missing', (SELECT count(*) FROM starts WHERE sample_id NOT IN (SELECT sample_id FROM entries))
UNION ALL SELECT 3, 'extra', (SELECT count(DISTINCT sample_id) FROM entries WHERE sample_id NOT IN (SELECT sample_id FROM starts))
UNION ALL SELECT 4, 'values', (SELECT count(*) FROM entries WHERE s % 52 = 8 AND sample_id IN (SELECT sample_id FROM starts)))
SELECT CAST(rank AS BIGINT) AS rank, item, CAST(bad AS BIGINT) AS bad, bad = 0 AS ok FROM bad""")
def coverage_report(spark, sf_dir):
    got = integrity.coverage_report(*faulty(spark, sf_dir), windows.HORIZON)
    return got.select(*long("rank"), "item", "bad", "ok")


@query("SELECT vec_id FROM embeddings WHERE label = 3 OR vec_id % 97 = 5")
def finite_check(spark, sf_dir):
    e = files.table(spark, sf_dir, "embeddings")
    bad = F.when(F.col("label") == 3, F.lit(float("nan"))).when(F.col("vec_id") % 97 == 5, F.lit(float("-inf"))).otherwise(F.lit(0.0))
    rows = e.withColumn("x", F.transform("embedding", lambda v: v.cast("double") + bad))
    return integrity.not_finite(rows, "x").select("vec_id")


@query("SELECT sha256(text) AS sha256, md5(text) AS md5, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL")
def fingerprint_manifest(spark, sf_dir):
    d = files.table(spark, sf_dir, "documents")
    slim = d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), F.octet_length("text").cast("long").alias("bytes"))
    return slim.groupBy("sha256", "md5", "bytes").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH want AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN sha256('x') ELSE sha256(text) END AS expected FROM benchmark), got AS (SELECT item_id, sha256(text) AS actual FROM benchmark WHERE item_id % 5 <> 0)
SELECT item_id, coalesce(actual, 'MISSING') AS actual, expected = coalesce(actual, 'MISSING') AS ok FROM want LEFT JOIN got USING (item_id)""")
def hash_check(spark, sf_dir):
    b = files.table(spark, sf_dir, "benchmark")
    want = b.select("item_id", F.sha2(F.when(F.col("item_id") % 7 == 0, F.lit("x")).otherwise(F.col("text")), 256).alias("sha256"))
    got = b.where("item_id % 5 <> 0").select("item_id", F.sha2("text", 256).alias("sha256"))
    return integrity.hashes_match(want, got, "item_id").select("item_id", "actual", "ok")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_b' ELSE 'only_a' END AS side FROM (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def key_diff(spark, sf_dir):
    a = files.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"))
    return integrity.key_diff(a, files.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"WITH {WINDOWS} SELECT CAST(2 * count(*) AS BIGINT) AS cells, CAST(0 AS BIGINT) AS one_sided, true AS same, CAST(0 AS BIGINT) AS beyond FROM starts")
def diff_report(spark, sf_dir):
    """Both cuts compared at all starts."""
    pts = points(spark, sf_dir)
    both = [f(pts, STRIDE).select("sample_id", scalar.array_pstd(F.col("past")).alias("sd"), scalar.array_sum(F.col("target")).alias("total")) for f in (windows.cut, windows.cut_frames)]
    got = compare.diff(*both, ["sample_id"], ["sd", "total"], atol=1e-12)
    return got.select("cells", "one_sided", ((F.col("max_abs") <= 1e-12) & (F.col("max_rel") <= 1e-12)).alias("same"), "beyond")


@query("SELECT event_type, 'k' AS key, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def manifest_mapjson(spark, sf_dir):
    e = files.table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "x"))
    return e.groupBy("event_type", "key").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT r_name AS grp, unnest([0, 1])::BIGINT AS pos, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN unnest([1, 5]) ELSE unnest([1, 52]) END::BIGINT AS p FROM region")
def daily_weekly_candidates(spark, sf_dir):
    r = files.table(spark, sf_dir, "region").select(F.col("r_name").alias("grp")).distinct()
    return r.select("grp", F.posexplode(scalar.period_candidates(F.col("grp"), ("ASIA", "EUROPE"))).alias("pos", "p")).select("grp", *long("pos", "p"))


@query("SELECT round(avg(value), 6) AS mean_ms, round(avg(value) * 2474 * 3 / 60000.0, 6) AS minutes FROM events")
def perf_extrapolation(spark, sf_dir):
    return compare.extrapolate(files.table(spark, sf_dir, "events"), "value", 2474, 3).select(*r6("mean_ms", "minutes"))


@query(f"WITH {WINDOWS} SELECT var_key, sample_id, round(sd, 6) AS sd FROM scaled QUALIFY row_number() OVER (PARTITION BY var_key ORDER BY s DESC) = 1")
def spot_check(spark, sf_dir):
    """Identity across sources: the last window of each variable, cut from the chunks and looked up again by its start."""
    pts = points(spark, sf_dir)
    keys = compare.first_per(windows.cut(pts, STRIDE).select("var_key", "sample_id", "s"), "var_key", [F.col("s").desc()])
    return windows.cut_at(pts, keys).select("var_key", "sample_id", F.round(scalar.array_pstd(F.col("past")), 6).alias("sd"))


@query("SELECT 'N0' AS method, CAST(2021 AS BIGINT) AS seed, n_name AS domain FROM nation WHERE n_nationkey % 4 = 0")
def grid_gaps(spark, sf_dir):
    n = files.table(spark, sf_dir, "nation")
    runs = n.where("n_nationkey % 4 <> 0").select(F.lit("N0").alias("method"), F.lit(2021).alias("seed"), F.col("n_name").alias("domain"))
    return integrity.grid_gaps(runs, ["N0"], [2021], [r[0] for r in n.select("n_name").collect()]).select("method", *long("seed"), "domain")


@query("SELECT event_type, true AS all_ok, true AS any_ok FROM events GROUP BY ALL UNION ALL SELECT 'none', true, false UNION ALL SELECT 'null', false, true")
def verdicts(spark, sf_dir):
    e = files.table(spark, sf_dir, "events").select("event_type", F.lit(True).alias("ok"))
    parts = [integrity.verdict(e, "ok", "event_type")]
    for name, f in (("none", e.limit(0)), ("null", spark.createDataFrame([(True,), (None,)], "ok boolean"))):
        parts.append(integrity.verdict(f).withColumn("event_type", F.lit(name)))
    rows = [p.select("event_type", "all_ok", "any_ok") for p in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _scratch(spark: SparkSession, tag: str) -> str:
    """A folder for a drill's files: the shared one, or a temporary one where none is set and all runs in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
    base = base or "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/plumbline-{tag}-{uuid.uuid4().hex}"


def _kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once and read back, for a query that needs it several times."""
    folder = _scratch(df.sparkSession, tag)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@query(f"WITH {PREDS} SELECT method, CAST(seed AS BIGINT) AS seed, domain, CAST(count(*) AS BIGINT) AS n, round(avg(y), 4) AS mean_pred FROM preds GROUP BY ALL")
def shard_roundtrip(spark, sf_dir):
    """Write the shards of all methods, seeds and domains, verify them for reuse in one job, and read them back."""
    shards = store.ShardStore(spark, _scratch(spark, "shards"))
    fp = store.fingerprint({"protocol": "eval-v1"}, {}, horizon=windows.HORIZON)
    written = sorted({tuple(w["shard"].split("__")) for w in shards.save_all(predictions(slim(spark, sf_dir)), fp)})
    keys = {(m, int(s[1:]), d) for m, d, s in written}
    if shards.discover() != sorted(keys) or shards.reuse_all(fp) != keys:
        raise integrity.ContractError("a fresh shard was not found, or rejected")
    rows = None
    for m in sorted({m for m, _, _ in written}):
        part = shards.entries(m, sorted({int(s[1:]) for n, _, s in written if n == m}), sorted({d for n, d, _ in written if n == m}))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("method", "seed", "domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.element_at("pred", 1)), 4).alias("mean_pred")).select("method", *long("seed"), "domain", "n", "mean_pred")


def _n0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.last_value(slim(spark, sf_dir)).withColumn("pos", F.col("s").cast("long"))


@query(f"WITH {WINDOWS} SELECT domain, CAST(count(*) AS BIGINT) AS n_rows, true AS same_hash, true AS in_order, true AS changed FROM starts GROUP BY domain")
def shard_manifest(spark, sf_dir):
    """Manifests of all shards of the last-value forecast: written again from other partitions they have the same hash; with one place changed they have not.

    ``in_order``: rows read back one after another keep the order of their variables' windows."""
    rows = _kept(_n0(spark, sf_dir), "manifest-rows")
    roots = {}
    for name, f in (("a", rows), ("b", rows.repartition(13, "sample_id")), ("c", rows.withColumn("pos", F.when(F.col("s") == 4, F.lit(-1)).otherwise(F.col("pos"))))):
        roots[name] = store.ShardStore(spark, _scratch(spark, f"manifest-{name}"))
        roots[name].save_all(f, {"protocol": "eval-v1"})
    a, b, c = (roots[k].manifests().select("domain", "n_rows", F.col("content").alias(k)) for k in "abc")
    order = roots["a"].in_order()
    both = a.join(b.drop("n_rows"), "domain").join(c.drop("n_rows"), "domain").join(order, "domain")
    return both.select("domain", "n_rows", (F.col("a") == F.col("b")).alias("same_hash"), "in_order", (F.col("a") != F.col("c")).alias("changed"))


_FAULTS_OF = {1: "", 2: "fingerprint", 3: "content hash,row count,duplicates", 4: "duplicates,missing", 5: "values", 6: "not finite", 7: "not finite"}
_FAULT_SQL = " ".join(f"WHEN 'line{k}' THEN '{v}'" for k, v in _FAULTS_OF.items())


@query(f"""WITH {WINDOWS}, sh AS (SELECT split_part(var_key, '__', 2) AS domain, count(*) AS n, count(*) FILTER (s = 0) AS first FROM starts GROUP BY ALL)
SELECT domain, CAST(n + CASE WHEN domain = 'line3' THEN first ELSE 0 END AS BIGINT) AS n_rows, CASE domain {_FAULT_SQL} END AS problems, domain IN ('line1', 'line7') AS good FROM sh""")
def quarantine_drill(spark, sf_dir):
    """All windows as seven shards by line number, six of them with a fault of their own; one job finds all, and what is rejected moves aside. The seventh is made anew."""
    rows = _kept(_n0(spark, sf_dir).withColumn("domain", F.split("var_key", "__", 2)[1]).drop("last", "mean", "std"), "drill-rows")
    of = lambda k: F.col("domain") == f"line{k}"
    nan = F.transform("pred", lambda _: F.lit(float("nan")))
    bad = rows.withColumns({"d": F.when(of(5), F.col("d") * (1 + 1e-12)).otherwise(F.col("d")), "pred": F.when(of(6) | of(7), nan).otherwise(F.col("pred"))})
    bad = bad.where(~(of(4) & (F.col("s") == 0))).unionByName(bad.where(of(4) & (F.col("s") == 4)))
    shards, fp = store.ShardStore(spark, _scratch(spark, "drill")), {"protocol": "eval-v1", "step": 48}
    heads = {h["shard"].split("__")[1]: h for h in shards.save_all(bad, fp)}
    shards.save_all(bad.where(of(2)), fp | {"step": 9})
    late = bad.where(of(3) & (F.col("s") == 0)).select(*store.COLUMNS, "pos")
    late.write.mode("append").parquet(f"{shards.shard_dir('N0', 0, 'line3')}/{heads['line3']['data']}")
    first = spark.createDataFrame([(r["domain"], r["n_rows"], ",".join(r["problems"])) for r in shards.verify(fp, rows).collect()], "domain string, n_rows long, problems string")  # a row a shard
    good = shards.reuse_all(fp, rows)
    shards.save_all(rows.where(of(7)), fp)
    if len(shards.quarantined()) != len(heads) - len(good):
        raise integrity.ContractError("a rejected shard is not in quarantine")
    after = shards.verify(fp, rows).where(F.size("problems") == 0).select("domain", F.lit(True).alias("good"))
    return first.join(after, "domain", "left").select("domain", "n_rows", "problems", F.coalesce("good", F.lit(False)).alias("good"))


@query(f"WITH {POINTS} SELECT var_key, CAST(count(*) AS BIGINT) AS n, CAST(round(100 * sum(v)) AS BIGINT) AS cents FROM points GROUP BY var_key")
def npz_source(spark, sf_dir):
    """Length and sum of every whole series."""
    return npz_chunks(spark, sf_dir).groupBy("var_key").agg(F.sum("series_len").cast("long").alias("n"), F.round(100 * F.sum(scalar.array_sum(F.col("values")))).cast("long").alias("cents"))


def npz_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole series in ragged caches, written with NumPy by the executors in bounded chunks and read by the source; and their flat columns by the data source."""
    folder = _scratch(spark, "npz")
    npz.write_ragged(series.chunks(points(spark, sf_dir), 0), folder)
    npz.register(spark)
    flat = spark.read.format("npz").option("path", folder).option("columns", "var_keys,chunk,series_len").load().select(F.col("var_keys").alias("var_key"), "chunk", "series_len")
    return flat.join(npz.ragged_series(spark, folder), ["var_key", "chunk"])


@query("""WITH base AS (SELECT *, 'grp' AS g, event_type || '__all__' || strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S') AS b, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS seen FROM events)
SELECT event_type || '__all' AS var_key, CASE WHEN seen > 1 THEN b || '__i' || event_id ELSE b END AS sample_id, CAST(event_id AS BIGINT) AS idx, value AS last FROM base""")
def zip_source(spark, sf_dir):
    """All events as ZIPs of JSON files, written by the executors in bounded pieces of one variable and read member by member."""
    rows = files.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("idx"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "value")
    folder = _scratch(spark, "zip")
    zipjson.write(rows, folder)
    return zipjson.samples(spark, folder).select("var_key", "sample_id", *long("idx"), F.element_at("past", -1).alias("last"))


@query("""SELECT CAST(p_partkey // 500 AS BIGINT) AS id, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS sha256, md5(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS md5,
    CAST(sum(octet_length(encode(p_name)) + 1) AS BIGINT) AS length FROM part GROUP BY ALL""")
def file_hashes(spark, sf_dir):
    """The names of all parts in files of 500 keys, written and hashed where they lie by the executors."""
    folder = _scratch(spark, "hashes")
    part = files.table(spark, sf_dir, "part").withColumn("id", F.floor(F.col("p_partkey") / 500))
    files.write_texts(part.select(F.format_string("%d.txt", "id").alias("path"), F.col("p_partkey").alias("k"), F.col("p_name").alias("line")), folder)
    got = files.hash_files(spark, folder, "*.txt")
    return got.select(F.regexp_extract("path", r"/([0-9]+)\.txt$", 1).cast("long").alias("id"), "sha256", "md5", "length")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(c_acctbal AS DOUBLE) / 7 AS score FROM customer WHERE c_acctbal / 7 < 250")
def archived_rows(spark, sf_dir):
    """All customers archived as CSV files by the distributed sink, read back with their schema and a predicate that reaches the scan."""
    folder = _scratch(spark, "archive")
    report.write_table(files.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), (F.col("c_acctbal") / 7).alias("score")), folder)
    return files.archived_table(spark, folder, "id long, name string, score double").where("score < 250")


@query(f"WITH {SPLITS}, fb AS (SELECT var_key, stddev_pop(v) AS x FROM points WHERE i < 96 GROUP BY var_key) SELECT domain, var_key, sample_id, split, CAST(pos AS BIGINT) AS pos, CAST(s AS BIGINT) AS s, round(x, 6) AS fallback_std FROM native JOIN fb USING (var_key)")
def split_manifest_rows(spark, sf_dir):
    """The splits of all variables, written by the executors as a manifest of lines, nested maps of a piece of a variable each, and read back."""
    pts = points(spark, sf_dir)
    folder = _scratch(spark, "manifest")
    files.write_manifest(splits.native(series.lengths(pts).join(series.fallback_std(pts), "var_key"), STRIDE), folder)
    variables_, rows = files.split_manifest(spark, folder, lines=True)
    return rows.join(variables_, "var_key").select("domain", "var_key", "sample_id", "split", *long("pos", "s"), *r6("fallback_std"))


@query(f"""WITH {POINTS}, w AS (SELECT domain, min(var_key) AS var_key FROM lens GROUP BY domain)
SELECT w.domain, w.var_key, CASE WHEN n >= 216 THEN w.var_key || '__' || strftime(TIMESTAMP '2000-01-01' + INTERVAL 204 HOUR, '%Y%m%dT%H%M%S') END AS sample_id, CASE WHEN n >= 216 THEN 0.0::DOUBLE END AS past_diff,
    CASE WHEN n >= 216 THEN (w.domain = 'N_O')::INT::DOUBLE END AS target_diff, n >= 216 AND w.domain <> 'N_O' AS ok FROM w JOIN lens USING (var_key)""")
def spot_check_sources(spark, sf_dir):
    """All series as an archive of ZIPs, a manifest and a cache, and the first variable of each domain held against one another.

    The manifest leaves out each variable's first window, so the first hit is the second sample; the archive's targets of one domain are off by one."""
    pts = points(spark, sf_dir)
    step = windows.CONTEXT + windows.HORIZON
    begins = F.to_timestamp_ntz(F.lit("2000-01-01 00:00:00")) + F.make_dt_interval(hours=F.col("s") + windows.CONTEXT)
    cut = windows.cut(pts, step).withColumns({"n": F.floor(F.col("s") / step), "begins": begins, "var": F.split("var_key", "__", 2)[1]})
    archive, manifest, cache = (_scratch(spark, f"spot-{k}") for k in ("zip", "manifest", "npz"))
    target = F.when(F.col("domain") == "N_O", F.transform("target", lambda x: x + 1)).otherwise(F.col("target"))
    member = F.format_string("wrapper/%s/%s.json", "domain", "var")
    zipjson.write_windows(cut.select(member.alias("member"), "n", F.date_format("begins", "yyyy-MM-dd'T'HH:mm:ss").alias("future_start"), "past", target.alias("target")), archive)
    listed = cut.where("s > 0").select("var_key", "domain", F.lit(1.0).alias("fallback_std"), F.lit("test").alias("split"), (F.col("n") - 1).alias("pos"), scalar.timestamp_id(F.col("domain"), F.col("var"), F.col("begins")).alias("sample_id"), "s")
    files.write_manifest(listed, manifest)
    npz.write_ragged(series.chunks(pts, step - 1), cache)
    first = {r["k"]: r["domain"] for r in series.lengths(pts).groupBy("domain").agg(F.min("var_key").alias("k")).collect()}  # a row a domain
    got = spot.spot_check(spark, {k: f"wrapper/{d}/{k.split('__', 1)[1]}.json" for k, d in first.items()}, archive, manifest, cache, series.CHUNK)
    return got.select(scalar.domain_of_key(F.col("var_key")).alias("domain"), "var_key", "sample_id", "past_diff", F.round("target_diff", 6).alias("target_diff"), "ok")


@query("SELECT event_type || '__all' AS var_key, CAST(event_id AS BIGINT) AS idx, CAST(NULL AS DOUBLE) AS first FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def zip_pruned(spark, sf_dir):
    """One variable's members of an archive of all events, without values: other members are not opened, and no number is read."""
    rows = files.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("idx"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("t"), "value")
    folder = _scratch(spark, "zip")
    zipjson.write(rows, folder)
    kind = rows.agg(F.min("kind")).first()[0]
    got = zipjson.samples(spark, folder, load_values=False, members=[f"wrapper/{kind}/all.json"])
    return got.select("var_key", *long("idx"), F.element_at("past", 1).alias("first"))


@query(f"WITH {LADDER} SELECT method, CAST(seed AS BIGINT) AS seed, CAST(count(*) AS BIGINT) AS n_vars, CAST(count(DISTINCT domain) AS BIGINT) AS n_domains, CAST(sum(n) AS BIGINT) AS n_windows FROM by_var GROUP BY ALL")
def merged_runs(spark, sf_dir):
    """Runs of single domains put together: refused unless each run has the same domains and every variable once."""
    lens = series.lengths(points(spark, sf_dir)).where("n >= 108").select("domain", "var_key").collect()  # a row a variable
    merged = integrity.merge_checked(variables(spark, sf_dir), {r["domain"] for r in lens}, len(lens))
    return merged.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n_vars"), F.countDistinct("domain").alias("n_domains"), F.sum("n").alias("n_windows")).select("method", *long("seed"), "n_vars", "n_domains", "n_windows")


@query("""SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, CAST(o_orderkey AS BIGINT) AS x FROM orders UNION ALL SELECT o_orderkey, CAST(1 AS BIGINT), CAST(o_custkey AS BIGINT) FROM orders""")
def numeric_lines(spark, sf_dir):
    """The lines of a command's output that are numbers; a status and a priority between them are none."""
    o = files.table(spark, sf_dir, "orders")
    text = F.concat(F.col("o_orderkey").cast("string"), F.lit("\r\n"), "o_orderstatus", F.lit("\n  "), F.col("o_custkey").cast("string"), F.lit(" \n"), "o_orderpriority")
    return o.select("o_orderkey", F.posexplode(scalar.integers_in(text)).alias("pos", "x")).select("o_orderkey", *long("pos"), "x")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, substr(sha256(c_name), 1, 12) AS prefix FROM customer")
def token_prefixes(spark, sf_dir):
    return files.table(spark, sf_dir, "customer").select(*[F.col("c_custkey").cast("long").alias("id")], scalar.token_prefix(F.col("c_name")).alias("prefix"))


@query("""SELECT l_returnflag, CAST(count(*) FILTER (abs(l_extendedprice - x) <= 1e-6) AS BIGINT) AS absolute, CAST(count(*) FILTER (abs(l_extendedprice - x) <= 1e-9 * abs(x)) AS BIGINT) AS relative, CAST(count(*) AS BIGINT) AS n
FROM (SELECT *, l_extendedprice * (1 + l_linenumber * 2.5e-10) AS x FROM lineitem) GROUP BY l_returnflag""")
def tolerances(spark, sf_dir):
    l = files.table(spark, sf_dir, "lineitem")
    a, x = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_linenumber") * 2.5e-10)
    return l.groupBy("l_returnflag").agg(F.count_if(scalar.within(a, x, atol=1e-6)).alias("absolute"), F.count_if(scalar.within(a, x, rtol=1e-9)).alias("relative"), F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT s_nationkey AS k FROM supplier) SELECT 'permuted' AS name, true AS same UNION ALL SELECT 'doubled', (SELECT count(*) FROM a) = 0
UNION ALL SELECT 'one side less', NOT EXISTS (SELECT * FROM a EXCEPT ALL SELECT * FROM a WHERE k <> 3)""")
def set_equality(spark, sf_dir):
    """Equality as multisets: order makes no difference, multiplicity does."""
    a = files.table(spark, sf_dir, "supplier").select("s_nationkey")
    others = [("permuted", a.orderBy(F.col("s_nationkey").desc())), ("doubled", a.unionAll(a)), ("one side less", a.where("s_nationkey <> 3"))]
    return spark.createDataFrame([(name, integrity.same_rows(a, b)) for name, b in others], "name string, same boolean")


@query("SELECT o_orderstatus AS method, CAST(0 AS BIGINT) AS seed, CAST(o_custkey AS VARCHAR) AS var_key, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n_domains FROM orders GROUP BY o_orderstatus, o_custkey HAVING count(*) > 1")
def duplicate_variables(spark, sf_dir):
    """Variables that several domain runs bring, here customers whose orders differ in priority: a merge must refuse them."""
    o = files.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("method"), F.lit(0).cast("long").alias("seed"), F.col("o_custkey").cast("string").alias("var_key"), F.col("o_orderpriority").alias("domain"))
    return integrity.unique_domain(o)


@query("""SELECT CAST(o_custkey AS BIGINT) AS id, '/orders/' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || '/' || unnest(['key', 'sums/0', 'sums/1/half']) AS path,
    unnest([CAST(o_orderkey AS DOUBLE), CAST(o_totalprice AS DOUBLE), CAST(o_totalprice AS DOUBLE) / 2]) AS value FROM orders UNION ALL SELECT DISTINCT CAST(o_custkey AS BIGINT), '/key', CAST(o_custkey AS DOUBLE) FROM orders""")
def nested_numbers(spark, sf_dir):
    """Every number of nested results, with its path: all orders, as a JSON document a customer; names, flags and nulls are none."""
    o = files.table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("double")
    one = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.to_json(F.array(price.cast("string"))).alias("skip"), price.alias("p"))
    per = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(one)).alias("orders"))
    text = lambda x: F.format_string('{"key": %d, "status": "%s", "open": true, "sums": [%s, {"half": %s, "none": null}]}', x["key"], x["status"], x["p"].cast("string"), (x["p"] / 2).cast("string"))
    doc = F.format_string('{"key": %d, "last": false, "empty": {}, "orders": [%s]}', F.col("o_custkey"), F.array_join(F.transform("orders", text), ","))
    return files.json_numbers(per.select(F.col("o_custkey").cast("long").alias("id"), doc.alias("doc")), "doc", depth=6)


@query(f"WITH {WINDOWS} SELECT domain, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS same_length, CAST(count(*) AS BIGINT) AS same_mean, true AS some_changed, true AS some_left FROM scaled GROUP BY domain")
def frequency_mask(spark, sf_dir):
    """Augmented windows keep their length and their mean; some change and some stay."""
    w = wins(spark, sf_dir).withColumn("before", F.concat("past", "target"))
    rows = forecast.frequency_mask(w, 7).withColumn("after", F.concat("past", "target"))
    mean = lambda c: scalar.array_mean(F.col(c))
    changed = F.exists(F.zip_with("before", "after", lambda x, y: F.abs(x - y)), lambda x: x > 1e-6)
    return rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.size("past") == windows.CONTEXT) & (F.size("target") == windows.HORIZON)).alias("same_length"),
        F.count_if(scalar.within(mean("after"), mean("before"), rtol=1e-9)).alias("same_mean"),
        F.bool_or(changed).alias("some_changed"),
        F.bool_or(~changed).alias("some_left"),
    )


@query("""WITH c AS (SELECT CAST(c_custkey // 96 AS BIGINT) AS chunk, c_custkey % 96 AS i, CAST(c_acctbal AS DOUBLE) AS b FROM customer)
SELECT chunk, unnest(['constant', 'ramp', 'sine', 'noise']) AS name, CAST(count(*) AS BIGINT) AS n, unnest([round(sum(3.5), 6), round(sum(i * 0.5), 6), round(sum(sin(i / 6.0)), 6), round(sum(b), 6)]) AS total FROM c GROUP BY chunk""")
def synthetic_series(spark, sf_dir):
    """The generator's four windows for every 96 customers, whose balances are the noise."""
    c = files.table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 96).alias("chunk"), (F.col("c_custkey") % 96).cast("int").alias("i"), F.col("c_acctbal").cast("double").alias("noise"))
    rows = files.synthetic_points(c)
    return rows.groupBy("chunk", "name").agg(F.count(F.lit(1)).alias("n"), F.round(exact.exact_sum("v"), 6).alias("total"))


@query("""SELECT 'src/' || (s_suppkey // 100) || '.py' AS path, md5(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS md5 FROM supplier GROUP BY s_suppkey // 100""")
def code_hashes(spark, sf_dir):
    """Hashes of code below a folder, all suppliers in files of a hundred keys: other suffixes and output folders are left out."""
    folder = f"{_scratch(spark, 'code')}/project"
    rows = files.table(spark, sf_dir, "supplier").select(F.floor(F.col("s_suppkey") / 100).alias("n"), F.col("s_suppkey").alias("k"), F.col("s_name").alias("line"))
    names = F.explode(F.array(*[F.format_string(x, "n") for x in ("src/%d.py", "results/%d.py", "src/%d.txt")]))
    files.write_texts(rows.withColumn("path", names), folder)
    return files.code_fingerprint(spark, folder)


@query("""SELECT CAST(n_nationkey AS BIGINT) AS id, unnest(['left', 'name', 'region']) AS key, unnest(['1', CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation""")
def merged_maps(spark, sf_dir):
    """Of two maps with a key in common the right one's value holds, a null too."""
    n = files.table(spark, sf_dir, "nation")
    left = F.create_map(F.lit("left"), F.lit("1"), F.lit("name"), F.lit("old"))
    right = F.create_map(F.lit("name"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")), F.lit("region"), F.col("n_regionkey").cast("string"))
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.explode(scalar.merge_maps(left, right)))


@query(f"""WITH {LADDER}, st AS (SELECT method, avg(mse) AS m, stddev_samp(mse) AS ms, avg(mae) AS a, stddev_samp(mae) AS sa, count(*) AS n FROM overall GROUP BY method)
SELECT method, CASE WHEN n = 1 THEN 'single' ELSE 'mean+-std over ' || n || ' seeds' END AS seed_stat, printf('%.6f', m) || CASE WHEN n = 1 THEN '' ELSE '+/-' || printf('%.6f', ms) END AS mse,
printf('%.6f', a) || CASE WHEN n = 1 THEN '' ELSE '+/-' || printf('%.6f', sa) END AS mae FROM st""")
def report_overall(spark, sf_dir):
    """The report's overall table, written as CSV and read back."""
    total = metrics.overall_level(metrics.domain_level(variables(spark, sf_dir)))
    path = f"{_scratch(spark, 'overall')}/overall.csv"
    report.write_csv(path, ["method", "seed_stat", "mse", "mae"], report.overall_rows(metrics.over_seeds(total)))
    return files.archived_table(spark, path, "method string, seed_stat string, mse string, mae string")


def _report_files(spark: SparkSession, sf_dir: str) -> str:
    """All report files of a run below one folder; the ladder is computed once."""
    folder = _scratch(spark, "report")
    variables(spark, sf_dir).write.parquet(f"{folder}-variables")
    by_var = spark.read.parquet(f"{folder}-variables")
    by_domain = metrics.domain_level(by_var)
    total = metrics.overall_level(by_domain)
    over = metrics.over_seeds(total)
    rows = {
        "overall": (["method", "seed_stat", "MSE", "MAE"], report.overall_rows(over)),
        "domain_summary": (["method", "domain", "seed_stat", "MSE", "MAE"], report.domain_rows(metrics.over_seeds(by_domain, "domain"))),
        "variable_level": (["method", "var_key", "n_windows", "std_MSE", "std_MAE", "raw_MSE", "raw_MAE"], report.variable_rows(metrics.over_seeds(by_var, "var_key"), by_var)),
        "improvement_counts": (["method", "level", "metric", "improved", "degraded", "equal", "total"], report.improvement_rows(compare.improvement_counts(by_domain, "domain", "N0"), "domain") + report.improvement_rows(compare.improvement_counts(by_var, "var_key", "N0"), "var")),
        "comparisons": (["comparison", "metric", "delta", "relative_improvement"], report.comparison_rows(compare.comparisons(total, PAIRS))),
        "fallback_summary": (["method", "seed", "overall_MSE", "overall_MAE", "n_fallback_domains"], report.fallback_rows(compare.with_fallback(by_domain, selection(by_domain), "N0"))),
    }
    for name, (header, body) in rows.items():
        report.write_csv(f"{folder}/{name}.csv", header, body)
    report.write_json(f"{folder}/aggregate_summary.json", report.summary(over))
    text = report.markdown("Evaluation", ["Equal weight from window to variable to domain to overall."], rows["overall"][1], rows["improvement_counts"][1], rows["comparisons"][1], rows["fallback_summary"][1], ["Overlapping windows are not independent samples."])
    report.atomic_write(f"{folder}/report.md", text.encode())
    return folder


@query(None)
def report_markdown(spark, sf_dir):
    """All report files of a run: (file, bytes > 0, lines)."""
    folder = _report_files(spark, sf_dir)
    return spark.createDataFrame([(p.rsplit("/", 1)[1], len(data) > 0, len(data.splitlines())) for p in files.list_files(folder) for data in [files.open_uri(p).read()]], "file string, written boolean, lines int")


_STAT = lambda m, n: f"printf('%.6f', avg({m})) || CASE WHEN count(*) = 1 THEN '' ELSE '+/-' || printf('%.6f', stddev_samp({m})) END AS {n}"
_REPORT_SQL = f"""WITH {LADDER}, o AS (SELECT method, {_STAT('mse', 'MSE')}, {_STAT('mae', 'MAE')} FROM overall GROUP BY method),
d AS (SELECT method, domain, {_STAT('mse', 'MSE')}, {_STAT('mae', 'MAE')} FROM by_domain GROUP BY ALL),
v AS (SELECT method, var_key, max(n) AS n, {_STAT('mse', 'MSE')}, {_STAT('mae', 'MAE')} FROM by_var GROUP BY ALL),
c AS (SELECT a.method || '-' || b.method AS k, x.metric, CASE x.metric WHEN 'mse' THEN a.m - b.m ELSE a.a - b.a END AS delta, CASE x.metric WHEN 'mse' THEN b.m ELSE b.a END AS ref
    FROM (VALUES ('S', 'N0'), ('M', 'N0'), ('S', 'M')) t(p, q) JOIN (SELECT method, avg(mse) AS m, avg(mae) AS a FROM overall GROUP BY method) a ON a.method = p JOIN (SELECT method, avg(mse) AS m, avg(mae) AS a FROM overall GROUP BY method) b ON b.method = q, (VALUES ('mse'), ('mae')) x(metric)),
n AS ({_counts_sql('by_domain', 'domain', 'domain')} UNION ALL {_counts_sql('by_var', 'var_key', 'var')}),
f AS (SELECT s.method, s.seed, avg(CASE WHEN s.fb THEN r.mse ELSE s.mse END) AS m, avg(CASE WHEN s.fb THEN r.mae ELSE s.mae END) AS a, count(*) FILTER (s.fb) AS k
    FROM (SELECT *, (seed + ascii(domain)) % 3 = 0 AS fb FROM by_domain WHERE method = 'S') s JOIN by_domain r ON r.method = 'N0' AND r.domain = s.domain GROUP BY ALL)
SELECT 'overall' AS file, method AS key, unnest(['MSE', 'MAE']) AS col, unnest([MSE, MAE]) AS cell FROM o
UNION ALL SELECT 'domain_summary', method || '|' || domain, unnest(['MSE', 'MAE']), unnest([MSE, MAE]) FROM d
UNION ALL SELECT 'variable_level', method || '|' || var_key, unnest(['n_windows', 'std_MSE', 'std_MAE']), unnest([CAST(n AS VARCHAR), MSE, MAE]) FROM v
UNION ALL SELECT 'improvement_counts', method || '|' || level || '(' || total || ')|' || metric, unnest(['improved', 'degraded', 'equal', 'total']), unnest([CAST(improved AS VARCHAR), CAST(degraded AS VARCHAR), CAST(equal AS VARCHAR), CAST(total AS VARCHAR)]) FROM n
UNION ALL SELECT 'comparisons', k || '|' || metric, unnest(['delta', 'relative_improvement']), unnest([printf('%+.6f', delta), printf('%+.2f%%', -delta / ref * 100)]) FROM c
UNION ALL SELECT 'fallback_summary', method || '|' || seed, unnest(['overall_MSE', 'overall_MAE', 'n_fallback_domains']), unnest([printf('%.6f', m), printf('%.6f', a), CAST(k AS VARCHAR)]) FROM f
UNION ALL SELECT 'aggregate_summary', method, unnest(['mse', 'mae']), unnest([printf('%.6f', avg(mse)), printf('%.6f', avg(mae))]) FROM overall GROUP BY method
UNION ALL SELECT 'report', method, 'line', '| ' || method || ' | ' || MSE || ' | ' || MAE || ' |' FROM o"""


@query(_REPORT_SQL)
def report_cells(spark, sf_dir):
    """Every cell of the report's tables, of the JSON summary and of the Markdown report's first table, as they stand in the files."""
    folder = _report_files(spark, sf_dir)
    keys = {"overall": ["method"], "domain_summary": ["method", "domain"], "variable_level": ["method", "var_key"], "improvement_counts": ["method", "level", "metric"], "comparisons": ["comparison", "metric"], "fallback_summary": ["method", "seed"]}
    out = None
    for name, own in keys.items():
        rows = spark.read.option("header", True).csv(f"{folder}/{name}.csv").drop("seed_stat", "raw_MSE", "raw_MAE")  # raw ones have more digits than doubles
        cells = rows.select(F.lit(name).alias("file"), F.concat_ws("|", *own).alias("key"), *[c for c in rows.columns if c not in own]).unpivot(["file", "key"], [c for c in rows.columns if c not in own], "col", "cell")
        out = cells if out is None else out.unionByName(cells)
    raw = spark.read.text(f"{folder}/aggregate_summary.json", wholetext=True).select(F.explode(F.from_json("value", "methods_overall map<string, struct<mse: array<double>, mae: array<double>>>")["methods_overall"]).alias("key", "x"))
    cell = F.explode(F.array(*[F.struct(F.lit(m).alias("col"), F.element_at(f"x.{m}", 1).cast("decimal(20,6)").cast("string").alias("cell")) for m in ("mse", "mae")])).alias("c")
    out = out.unionByName(raw.select(F.lit("aggregate_summary").alias("file"), "key", cell).select("file", "key", "c.*"))
    lines = spark.read.text(f"{folder}/report.md").where(F.col("value").rlike(r"^\| [A-Z0-9]+ \| [0-9.+/-]+ \| [0-9.+/-]+ \|$"))
    return out.unionByName(lines.select(F.lit("report").alias("file"), F.split("value", " ")[1].alias("key"), F.lit("line").alias("col"), F.col("value").alias("cell")))


_LEVELS = " UNION ALL ".join(f"SELECT '{name}' AS level, count(*) AS n FROM {level}" for name, level in (("variable", "by_var"), ("domain", "by_domain"), ("overall", "overall")))
_METRIC = "unnest(['mse', 'mae', 'raw_mse', 'raw_mae'])"


@query(f"""WITH {LADDER}, lv AS ({_LEVELS}), two AS (SELECT level, n, {_METRIC} AS metric FROM lv)
SELECT 'two routes' AS section, level || ':' || metric AS item, CAST(n AS BIGINT) AS cells, CAST(0 AS BIGINT) AS beyond, true AS ok FROM two
UNION ALL SELECT 'planted', level || ':' || metric, CAST(n AS BIGINT), CAST((level = 'overall' AND metric = 'mae')::INT AS BIGINT), NOT (level = 'overall' AND metric = 'mae') FROM two
UNION ALL SELECT 'archive', 'overall:' || unnest(['mse', 'mae']), CAST(n AS BIGINT), CAST(0 AS BIGINT), true FROM lv WHERE level = 'overall'
UNION ALL SELECT 'planted archive', 'overall:' || m, CAST(n AS BIGINT), CAST((m = 'mse')::INT AS BIGINT), m <> 'mse' FROM (SELECT n, unnest(['mse', 'mae']) AS m FROM lv WHERE level = 'overall')""")
def verify_ladder(spark, sf_dir):
    """All cells of the ladder by two routes, and the overall values against a table archived with six decimals; a fault of 1e-9 planted in one cell, and one of 1e-6 in the archive, are found.

    The evidence is written as a JSON file a section, too."""
    folder = _scratch(spark, "verify")
    predictions(slim(spark, sf_dir)).select("method", "seed", "domain", "var_key", "sample_id", "pred", "target", "d").write.parquet(f"{folder}/preds")  # both routes read the same predictions
    preds = spark.read.parquet(f"{folder}/preds")
    by_var = _kept(metrics.variable_level(metrics.score(preds)), "first-route")  # each route reads the predictions once
    total = metrics.overall_level(metrics.domain_level(by_var))
    rows = [[r["method"], r["seed"], f"{r['mse']:.6f}", f"{r['mae']:.6f}"] for r in total.orderBy("method", "seed").collect()]  # a row a run
    report.write_csv(f"{folder}/archive.csv", ["method", "seed", "MSE", "MAE"], rows)
    archive = files.archived_table(spark, f"{folder}/archive.csv", "method string, seed int, MSE double, MAE double")
    first, second = metrics.ladder_of(by_var), verify.long_ladder_of(_kept(verify.long_variables(preds), "second-route"))
    hit = (F.col("level") == "overall") & (F.col("metric") == "mae") & (F.col("method") == "M")
    planted = first.withColumn("value", F.when(hit, F.col("value") + 1e-9).otherwise(F.col("value")))
    wrong = archive.withColumn("MSE", F.when(F.col("method") == "M", F.col("MSE") + 1.1e-6).otherwise(F.col("MSE")))
    got = verify.agreement(first, second, "two routes").unionByName(verify.agreement(planted, second, "planted"))
    got = got.unionByName(verify.archived(total, archive, "archive")).unionByName(verify.archived(total, wrong, "planted archive"))
    got.write.parquet(f"{folder}/evidence")
    got = spark.read.parquet(f"{folder}/evidence")  # a row a level and metric
    report.write_evidence(got, f"{folder}/report")
    return got.select("section", "item", "cells", "beyond", "ok")


@query(f"""WITH {WINDOWS}, t AS (SELECT domain, count(*) AS n FROM starts GROUP BY domain), want AS (SELECT domain, n + (domain = 'N_O')::INT AS n FROM t WHERE domain <> 'R_F')
SELECT 'rows' AS item, CAST((SELECT sum(n) FROM want) AS BIGINT) AS expected, CAST((SELECT sum(n) FROM t) AS BIGINT) AS actual, (SELECT sum(n) FROM want) = (SELECT sum(n) FROM t) AS ok
UNION ALL SELECT 'not finite', 0, 0, true UNION ALL SELECT 'not positive', 0, 0, true
UNION ALL SELECT 'other groups', 0, CAST(coalesce((SELECT n FROM t WHERE domain = 'R_F'), 0) AS BIGINT), coalesce((SELECT n FROM t WHERE domain = 'R_F'), 0) = 0
UNION ALL SELECT 'domain:' || domain, CAST(want.n AS BIGINT), CAST(t.n AS BIGINT), want.n = t.n FROM want JOIN t USING (domain)""")
def totals_in_passing(spark, sf_dir):
    """All windows written once, and counted by domain in that write, against totals worked out from the series' lengths; of those, one is off by one and one domain is left out."""
    lens = series.lengths(points(spark, sf_dir))
    n = F.greatest(F.floor((F.col("n") - windows.CONTEXT - windows.HORIZON) / STRIDE) + 1, F.lit(0))
    totals = {r["domain"]: r["n"] for r in lens.groupBy("domain").agg(F.sum(n).cast("long").alias("n")).orderBy("domain").collect() if r["n"]}  # a row a domain
    seen = passing.Passing({d: k + (d == "N_O") for d, k in totals.items() if d != "R_F"}, numbers=("target", "d", "last"), positive=("d",))
    seen.watch(slim(spark, sf_dir)).write.parquet(_scratch(spark, "windows"))
    return spark.createDataFrame([(r["item"], r["expected"], r["actual"], r["ok"]) for r in seen.report()], "item string, expected long, actual long, ok boolean")


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, true AS same FROM embeddings")
def npy_roundtrip(spark, sf_dir):
    """All embeddings as array files, written by the tasks and committed by the driver, read back in ranges of rows and held against the table."""
    e = files.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    folder = _scratch(spark, "npy")
    npy.write(e.select(F.col("vec_id").alias("i"), F.concat(F.array(F.col("vec_id").cast("double")), F.col("own")).alias("values")), folder)
    back = npy.read(spark, folder, split_rows="512").select(F.element_at("values", 1).cast("long").alias("id"), F.slice("values", F.lit(2), F.size("values")).alias("v"))
    rows = e.join(back, e["vec_id"] == back["id"], "full_outer")
    return rows.select(F.col("id").alias("vec_id"), F.size("v").cast("long").alias("n"), F.round(scalar.array_sum(F.col("v")), 6).alias("total"), F.coalesce(F.col("own") == F.col("v"), F.lit(False)).alias("same"))


@query("""WITH e AS (SELECT 'g' || (vec_id % 16) || '/b' || (vec_id // 256) || '/v' || vec_id AS path, vec_id, len(embedding) AS n FROM embeddings)
SELECT path, CASE WHEN vec_id % 97 = 5 THEN 'changed' ELSE 'removed' END AS kind, CASE WHEN vec_id % 97 = 5 THEN CAST(vec_id % n AS BIGINT) END AS position FROM e WHERE vec_id % 97 = 5 OR vec_id % 101 = 7
UNION ALL SELECT path || 'x', 'added', NULL FROM e WHERE vec_id % 103 = 9 AND NOT (vec_id % 97 <> 5 AND vec_id % 101 = 7)""")
def state_changes(spark, sf_dir):
    """All embeddings as a state of nested arrays, before and after: one element of some is changed, some are gone and some are new; all are named."""
    e = files.table(spark, sf_dir, "embeddings").withColumn("path", F.format_string("g%d/b%d/v%d", F.col("vec_id") % 16, F.floor(F.col("vec_id") / 256), "vec_id"))
    before = e.select("path", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    hit = F.col("vec_id") % 97 == 5
    after = before.where(hit | (F.col("vec_id") % 101 != 7)).withColumn("values", F.when(hit, F.transform("values", lambda x, i: F.when(i == F.col("vec_id") % F.size("values"), x + 1e-9).otherwise(x))).otherwise(F.col("values")))
    after = after.unionByName(after.where("vec_id % 103 = 9").withColumn("path", F.concat("path", F.lit("x"))))
    folder = _scratch(spark, "state")
    trees = [state.save_tree(f.select("path", "values"), f"{folder}/{k}", 3) for k, f in (("before", before), ("after", after))]
    leaves, _ = state.differing(*trees, 3)
    return state.changes(before, after, leaves).select("path", "kind", *long("position"))


@query("""WITH b AS (SELECT vec_id // 64 AS b, count(*) AS n FROM embeddings GROUP BY ALL)
SELECT 'layer.' || b || '.weight' AS name, CASE WHEN b % 11 = 5 THEN 'missing' WHEN b % 7 = 3 THEN 'changed' ELSE 'same' END AS state, CASE WHEN b % 11 <> 5 THEN CAST(n AS BIGINT) END AS n_rows FROM b
UNION ALL SELECT 'layer.' || b || '.extra', 'unexpected', CAST(n AS BIGINT) FROM b WHERE b % 13 = 1""")
def frozen_weights(spark, sf_dir):
    """All embeddings as tensors of 64 vectors in files of sixteen, written by the executors with their hashes; a bit of some is flipped, some are left out and some are not in the manifest."""
    import pandas as pd

    folder = _scratch(spark, "tensors")
    rows = files.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("b")).withColumn("file", F.floor(F.col("b") / 16))

    def save(key, part):  # at most 1,024 vectors
        import hashlib

        import numpy as np

        out, names = {}, []
        for b, own in part.sort_values("vec_id").groupby("b"):
            x, name = np.stack(own["embedding"].to_numpy()).astype(np.float32), f"layer.{b}.weight"
            names.append((name, hashlib.sha256(x.tobytes()).hexdigest()))
            if b % 11 != 5:
                if b % 7 == 3:
                    x.view(np.uint32)[0, 0] ^= 1
                out[name] = x
            if b % 13 == 1:
                out[f"layer.{b}.extra"] = x
        tensors.write(f"{folder}/{key[0]:08d}.bin", out)
        return pd.DataFrame(names, columns=["name", "sha256"])

    rows.groupBy("file").applyInPandas(save, "name string, sha256 string").write.parquet(f"{folder}-manifest")
    found = tensors.table(spark, folder)
    got = tensors.against(found, spark.read.parquet(f"{folder}-manifest"))
    return got.join(found.select("name", F.element_at("shape", 1).alias("n_rows")), "name", "left").select("name", "state", "n_rows")


@query(f"""WITH {WINDOWS}, t AS (SELECT domain, count(*) AS n, count(DISTINCT var_key) AS v FROM starts GROUP BY domain)
SELECT 'gate:' || unnest(['files', 'counts', 'totals by domain', 'unique keys', 'reference keys', 'finite windows, positive scale']) AS item, CAST(1 AS BIGINT) AS value
UNION ALL SELECT 'would run:windows', CAST(2 * sum(n) AS BIGINT) FROM t UNION ALL SELECT 'would run:shards', CAST(2 * count(*) AS BIGINT) FROM t
UNION ALL SELECT 'exit code:locked', 1 UNION ALL SELECT 'exit code:rejected', 2 UNION ALL SELECT 'exit code:approved dry run', 2
UNION ALL SELECT 'gap:' || min(domain), CAST(arg_min(n, domain) + 1 AS BIGINT) FROM t""")
def gate_report(spark, sf_dir):
    """The gate, the dry run and the approval of an evaluation of all windows, from a config file; a total that is off by one is named by its domain."""
    import contextlib
    import hashlib
    import io
    import re

    from plumbline.plans import evaluate

    folder = _scratch(spark, "gate")
    wins(spark, sf_dir).write.parquet(f"{folder}/windows")
    w = spark.read.parquet(f"{folder}/windows")
    forecast.last_value(w).select("method", "seed", "domain", "var_key", "sample_id", "pred", "target", "d").write.parquet(f"{folder}/reference")
    lens = series.lengths(points(spark, sf_dir)).withColumn("w", F.greatest(F.floor((F.col("n") - windows.CONTEXT - windows.HORIZON) / STRIDE) + 1, F.lit(0))).where("w > 0")
    totals = {r["domain"]: (r["w"], r["v"]) for r in lens.groupBy("domain").agg(F.sum("w").cast("long").alias("w"), F.count(F.lit(1)).alias("v")).collect()}  # a row a domain
    files.write_bytes(f"{folder}/frozen.txt", b"frozen")
    expect = {"windows": sum(n for n, _ in totals.values()), "variables": sum(v for _, v in totals.values()), "domains": len(totals), "by_domain": {d: n for d, (n, _) in totals.items()}}
    config = {"windows": f"{folder}/windows", "reference": f"{folder}/reference", "out": f"{folder}/out", "method": "S", "seeds": [1, 2], "expect": expect, "files": {f"{folder}/frozen.txt": hashlib.sha256(b"frozen").hexdigest()}}
    raw = json.dumps(config).encode()
    files.write_bytes(f"{folder}/config.json", raw)
    call = lambda *a: evaluate.main(["--config", f"{folder}/config.json", *a], spark=spark)
    said = io.StringIO()
    with contextlib.redirect_stdout(said), contextlib.redirect_stderr(io.StringIO()):
        codes = {"locked": call(), "rejected": call("--approve", "0" * 12), "approved dry run": call("--approve", hashlib.sha256(raw).hexdigest()[:12], "--dry-run")}
        call("--dry-run")
    plan = json.loads(said.getvalue())
    rows = [(f"gate:{x['item']}", int(x["ok"])) for x in plan["gate"]] + [(f"would run:{k}", plan["would_run"][k]) for k in ("windows", "shards")] + [(f"exit code:{k}", v) for k, v in codes.items()]
    first = min(totals)
    try:
        evaluate.gate(spark, config | {"expect": expect | {"by_domain": expect["by_domain"] | {first: totals[first][0] + 1}}})
    except integrity.ContractError as e:
        rows += [(f"gap:{d}", int(want)) for d, want in re.findall(r"'([^']+)': \[\d+, (\d+)\]", str(e))]
    return spark.createDataFrame(rows, "item string, value long")
