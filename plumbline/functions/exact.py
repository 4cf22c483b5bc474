"""Exact sums of doubles that do not depend on the order of rows, in built-in aggregates only.

A double is cut into whole numbers on a fixed grid of LIMBS limbs of WIDTH bits, from 2**LOW up; each limb is summed as a long, which is exact in
any order and on any partitioning. The sums of a group's limbs are put together in a fixed way, so equal rows give equal bits. A limb's sum holds
2**35 rows; past that it overflows and, under ANSI, says so.

Bits of a value below 2**LOW are cut off, each value for itself. A magnitude of 2**HIGH or more counts as infinite. Nulls are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalar import array_mean, let

WIDTH, LIMBS, LOW = 28, 8, -112
HIGH = LOW + WIDTH * LIMBS


def _sql(x: str) -> list[str]:
    """The limbs of column ``x`` as SQL, lowest first: longs with its sign, null where x is null, NaN or beyond the grid.

    The remainder by a power of two is exact, and so is the quotient; the cast cuts towards zero.
    """
    unit = [f"{2.0 ** (LOW + WIDTH * k)!r}D" for k in range(LIMBS + 1)]
    return [f"CAST(CASE WHEN abs({x}) < {unit[-1]} THEN {x} % {above} / {own} END AS BIGINT)" for own, above in zip(unit, unit[1:])]


def _sum_sql(name: str) -> str:
    """A group's limbs are put together from the highest down. As long as terms could cancel, they are small enough to be added exactly
    (below 2**23 rows a group), so the error is a few units in the last place."""
    x, out = f"`{name}`", "0D"
    for limb in reversed(_sql(x)):
        out = f"({out} * {2.0**WIDTH!r}D + CAST(sum({limb}) AS DOUBLE))"
    beyond = f"sum(CASE WHEN abs({x}) >= {2.0**HIGH!r}D THEN CASE WHEN isnan({x}) THEN {x} ELSE signum({x}) * double('Infinity') END END)"
    return f"coalesce({beyond}, {out} * {2.0**LOW!r}D)"


def exact_sum(name: str) -> Column:
    """An aggregate: the sum of a double column; null of no values. NaN and infinite values count as in any sum."""
    return F.expr(_sum_sql(name))


def exact_avg(name: str) -> Column:
    return F.expr(f"{_sum_sql(name)} / nullif(count(`{name}`), 0)")


def sample_std(name: str) -> Column:
    """An aggregate for a few values, such as a run's seeds: the sample standard deviation in two passes over the sorted values; null of one."""

    def spread(xs: Column) -> Column:
        return let(array_mean(xs), lambda m: F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / F.nullif(F.size(xs) - 1, F.lit(0))))

    return let(F.array_sort(F.collect_list(name)), lambda xs: F.when(F.size(xs) > 1, spread(xs)))
