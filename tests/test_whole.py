"""Queries over whole tables, against brute force."""

import pytest

from plumbline.plans import queries
from plumbline.plans.registry import QUERIES
from plumbline.sources import zipjson


def test_zip_of_all_events(spark, sf, duck):
    got = {tuple(r) for r in QUERIES["zip_source"](spark, sf).collect()}
    want, seen = set(), set()
    for kind, hour, i, value in duck.execute("SELECT event_type, strftime(date_trunc('hour', ts), '%Y%m%dT%H%M%S'), event_id, value FROM events ORDER BY event_id").fetchall():
        base = f"{kind}__all__{hour}"
        want.add((f"{kind}__all", f"{base}__i{i}" if base in seen else base, i, value))
        seen.add(base)
    assert got == want and len(got) > 300


def test_ids_go_on_over_zips(spark, tmp_path):
    rows = spark.createDataFrame([("k", i, "2030-01-01T00:00:00", float(i)) for i in range(10)], "kind string, idx long, t string, value double")
    zipjson.write(rows, str(tmp_path), ids=3)
    assert len(list(tmp_path.glob("*.zip"))) == 4
    got = {r["idx"]: r["sample_id"] for r in zipjson.samples(spark, str(tmp_path)).collect()}
    assert got == {0: "k__all__20300101T000000"} | {i: f"k__all__20300101T000000__i{i}" for i in range(1, 10)}


POINTS = f"WITH {queries.POINTS} SELECT var_key, i, v FROM points"


def test_npz_of_whole_series(spark, sf, duck):
    want = duck.execute(f"SELECT var_key, count(*), sum(v) FROM ({POINTS}) GROUP BY ALL").fetchall()
    got = {r["var_key"]: (r["n"], r["cents"] / 100) for r in QUERIES["npz_source"](spark, sf).collect()}
    assert len(got) == len(want) and max(n for _, n, _ in want) > 120
    for key, n, total in want:
        assert got[key][0] == n and got[key][1] == pytest.approx(total, abs=0.02)


def series_of(duck):
    out = {}
    for key, _, v in sorted(duck.execute(POINTS).fetchall()):
        out.setdefault(key, []).append(v)
    return out


def test_long_form_of_all_windows(spark, sf, duck):
    want = {(f"{key}__{s}", k, v[s + k]) for key, v in series_of(duck).items() for s in range(0, len(v) - 107, queries.STRIDE) for k in range(108)}
    got = [(r["sample_id"], r["k"], r["v"]) for r in QUERIES["windows_long"](spark, sf).select("sample_id", "k", "v").toLocalIterator()]
    assert len(got) == len(want) and set(got) == want and any(int(i.rsplit("__", 1)[1]) % 48 for i, _, _ in got)


def test_diff_of_all_windows(spark, sf, duck):
    n = sum(len(range(0, len(v) - 107, queries.STRIDE)) for v in series_of(duck).values())
    assert [tuple(r) for r in QUERIES["diff_report"](spark, sf).collect()] == [(2 * n, 0, True, 0)]


def test_shards_of_all_methods(spark, sf, duck):
    want = duck.execute(f"WITH {queries.PREDS} SELECT method, seed, domain, count(*), avg(y) FROM preds GROUP BY ALL").fetchall()
    got = {(r["method"], r["seed"], r["domain"]): (r["n"], r["mean_pred"]) for r in QUERIES["shard_roundtrip"](spark, sf).collect()}
    assert len(got) == len(want) and {m for m, _, _ in got} == {"N0", "M", "S"} and len({d for _, _, d in got}) == 6
    for m, s, d, n, mean in want:
        assert got[m, s, d][0] == n and got[m, s, d][1] == pytest.approx(mean, abs=2e-4)
