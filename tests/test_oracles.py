"""Every registered query against its own SQL in DuckDB, which is shaped differently (range joins instead of array slices)."""

import pytest

from plumbline.plans import queries  # noqa: F401
from plumbline.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_report_files(spark, sf):
    got = {r["file"]: r for r in QUERIES["report_markdown"](spark, sf).collect()}
    assert len(got) == 8 and all(r["written"] for r in got.values())
    assert got["overall.csv"]["lines"] == 4 and got["domain_summary.csv"]["lines"] == 19


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
