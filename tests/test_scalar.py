"""Closed forms of the protocol's functions, and the places where Spark's defaults differ from them."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import formats, scalar


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


@pytest.mark.parametrize("past,fallback,want", [
    ((1, 2, 3, 4), 99.0, 1.118033988749895),
    ((5.0,) * 96, 99.0, 99.0),
    ((1, math.nan, 3), 7.0, 7.0),
    ((1e-8, -1e-8), 3.0, 1e-8),
    ((9e-9, -9e-9), 3.0, 3.0),
])
def test_window_scale(spark, past, fallback, want):
    assert one(spark, scalar.window_scale(arr(*past), F.lit(fallback))) == want


def test_errors(spark):
    z = scalar.scaled(scalar.errors(arr(1, 2), arr(0, 4)), F.lit(2.0))
    assert one(spark, scalar.mean_square(z)) == 0.625
    assert one(spark, scalar.mean_abs(z)) == 0.75


def test_finite(spark):
    for x, want in ((1.0, True), (math.nan, False), (math.inf, False), (-math.inf, False)):
        assert one(spark, scalar.finite(F.lit(x))) is want
        assert one(spark, scalar.all_finite(arr(0, x))) is want
    assert one(spark, scalar.all_finite(F.lit(None).cast("array<double>"))) is False


def test_seed(spark):
    for base, key, sid in ((2021, "a__b", "a__b__0"), (2023, "é__x", ""), (1, "k", "s|t")):
        want = int.from_bytes(hashlib.sha256(f"eval-v1|{base}|{key}|{sid}".encode()).digest()[:8], "big") % (2**31 - 1)
        assert one(spark, scalar.derive_seed(F.lit(base), F.lit(key), F.lit(sid))) == want


def test_keys_and_paths(spark):
    assert one(spark, scalar.domain_of_key(F.lit("d__v__w"))) == "d"
    assert one(spark, scalar.strip_member(F.lit("wrap/g/d/v.json"))) == "g/d/v"
    assert tuple(one(spark, scalar.path_group_domain(F.lit("g")))) == ("g", "g")
    assert tuple(one(spark, scalar.path_group_domain(F.lit("g/d/e")))) == ("g", "d")
    assert one(spark, scalar.timestamp_id(F.lit("d"), F.lit("v"), F.lit("2023-10-29T00:00:00").cast("timestamp_ntz"))) == "d__v__20231029T000000"


def test_updates_and_periods(spark):
    assert tuple(one(spark, scalar.update_counts(F.lit(33)))) == (2, 64)
    assert tuple(one(spark, scalar.update_counts(F.lit(32)))) == (1, 32)
    assert one(spark, scalar.period_candidates(F.lit("x"), ("x", "y"))) == [1, 5]
    assert one(spark, scalar.period_candidates(F.lit("z"), ("x", "y"))) == [1, 52]


def test_ratio_and_tolerance(spark):
    assert one(spark, scalar.relative_improvement(F.lit(3.0), F.lit(0.0))) is None
    assert one(spark, scalar.relative_improvement(F.lit(3.0), F.lit(2.0))) == -50.0
    assert one(spark, scalar.within(F.lit(1.0), F.lit(1.1), atol=0.05)) is False
    assert one(spark, scalar.within(F.lit(1.0), F.lit(1.1), rtol=0.1)) is True


def test_numbers_in_output(spark):
    assert one(spark, scalar.integers_in(F.lit("12\n x\r\n 7 \n"))) == [12, 7]


def test_revin(spark):
    n = scalar.revin_normalise(arr(1, 2, 3, 4))
    back = spark.range(1).select(n.alias("n")).select(scalar.revin_inverse(F.col("n.z"), F.col("n.mean"), F.col("n.std")).alias("b"), "n.std").first()
    assert back["std"] == pytest.approx(1.118033988749895 + 1e-5, abs=1e-15)
    assert back["b"] == pytest.approx([1, 2, 3, 4], abs=1e-12)


def test_formats():
    assert formats.mean_std(1.0, None) == "1.000000"
    assert formats.mean_std(1.0, 0.5) == "1.000000+/-0.500000"
    assert formats.relative(None) == "ref=0, ratio undefined"
    assert formats.relative(0.125) == "+0.12%" and formats.relative(-0.0) == "-0.00%"
    assert formats.delta(0.0) == "+0.000000"
