import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from plumbline.session import session

    s = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(pdf):
    cols = sorted(pdf.columns)
    plain = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(map(str, r)) for r in plain.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        got, want = df.toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        for c in got.columns:  # a column with nulls may come as double on one side
            if got[c].dtype.kind == "f" and want[c].dtype.kind in "iuO" or want[c].dtype.kind == "f" and got[c].dtype.kind in "iuO":
                got[c], want[c] = got[c].astype("float64"), want[c].astype("float64")
        assert rows_of(got) == rows_of(want)

    return check
