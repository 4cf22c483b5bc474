"""Column functions of the protocol: array statistics, scoring, keys, seeds, formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
INF = float("inf")


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite. Spark orders NaN above all numbers, so the comparison alone would not do."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(INF))


def all_finite(xs: Column) -> Column:
    return F.coalesce(F.forall(xs, finite), F.lit(False))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside another lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def array_mean(xs: Column) -> Column:
    return array_sum(xs) / F.nullif(F.size(xs), F.lit(0))


def array_pstd(xs: Column, mean: Column | None = None) -> Column:
    """Population standard deviation, in two passes."""
    m = array_mean(xs) if mean is None else mean
    return let(m, lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.nullif(F.size(xs), F.lit(0))))


def scale_or_fallback(std: Column, fallback: Column, eps: float = EPS) -> Column:
    """``std`` if it is a number of at least ``eps``, else ``fallback``; NaN falls back too."""
    return F.when(std.isNull() | F.isnan(std) | (std < eps), fallback).otherwise(std)


def window_scale(past: Column, fallback: Column, eps: float = EPS) -> Column:
    return scale_or_fallback(array_pstd(past), fallback, eps)


def errors(pred: Column, target: Column) -> Column:
    return F.zip_with(pred, target, lambda p, t: p - t)


def mean_square(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x) / F.nullif(F.size(xs), F.lit(0))


def mean_abs(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.abs(x)) / F.nullif(F.size(xs), F.lit(0))


def scaled(xs: Column, d: Column) -> Column:
    return let(d, lambda d: F.transform(xs, lambda x: x / d))


def var_key(domain: Column, var: Column) -> Column:
    return F.concat_ws("__", domain, var)


def domain_of_key(key: Column) -> Column:
    """What stands before the first double underscore."""
    return F.split(key, "__", 2)[0]


def path_group_domain(path: Column) -> Column:
    """struct(grp, domain) of a directory path: one part is both, else the first two."""
    parts = F.split(path, "/")
    return F.struct(parts[0].alias("grp"), F.when(F.size(parts) == 1, parts[0]).otherwise(F.get(parts, F.lit(1))).alias("domain"))


def strip_member(path: Column) -> Column:
    """Archive member -> relative path without the wrapping directory and the suffix."""
    return F.regexp_replace(F.regexp_replace(path, "^[^/]+/", ""), r"\.json$", "")


def timestamp_id(domain: Column, var: Column, ts: Column) -> Column:
    return F.concat_ws("__", domain, var, F.date_format(ts, "yyyyMMdd'T'HHmmss"))


def derive_seed(base_seed: Column, key: Column, sample_id: Column, namespace: str = "eval-v1") -> Column:
    """First eight bytes of SHA-256 of ``namespace|base_seed|key|sample_id``, big-endian, modulo 2**31 - 1."""
    token = F.concat_ws("|", F.lit(namespace), base_seed.cast("string"), key, sample_id)
    word = F.conv(F.substring(F.sha2(token, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (word % F.lit(2147483647)).cast("long")


def update_counts(n: Column, batch: int = 32) -> Column:
    """struct(updates, samples): batches that hold n samples, and the samples that they then draw."""
    u = F.ceil(n / batch).cast("long")
    return F.struct(u.alias("updates"), (u * batch).alias("samples"))


def period_candidates(grp: Column, daily: tuple[str, ...]) -> Column:
    return F.when(grp.isin(*daily), F.array(F.lit(1), F.lit(5))).otherwise(F.array(F.lit(1), F.lit(52)))


def revin_normalise(past: Column, eps: float = 1e-5) -> Column:
    """struct(mean, std, z): the model's own normalisation, whose scale is never the scoring scale."""
    mean = array_mean(past)

    def scaled_by(m: Column) -> Column:
        return let(array_pstd(past, m) + F.lit(eps), lambda s: F.struct(m.alias("mean"), s.alias("std"), F.transform(past, lambda x: (x - m) / s).alias("z")))

    return let(mean, scaled_by)


def revin_inverse(z: Column, mean: Column, std: Column) -> Column:
    return let(std, lambda s: let(mean, lambda m: F.transform(z, lambda x: x * s + m)))


def relative_improvement(value: Column, reference: Column) -> Column:
    """Percent by which value lies below reference; null where the reference is 0."""
    return F.when(reference != 0, -(value - reference) / reference * 100)


def within(a: Column, b: Column, rtol: float = 0.0, atol: float = 0.0) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def merge_maps(left: Column, right: Column) -> Column:
    """All keys of both maps; the right one's value holds where both have a key, even if it is null. Null if either map is."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def token_prefix(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def integers_in(text: Column) -> Column:
    """The lines of a command's output that are numbers, as longs."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("long"))
