"""Every registered query of the log engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keystrata import queries as core


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        p = f"{sf_dir}/{f}"
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = core.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    theirs = duck.sql(core.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    place = [theirs.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in place) for r in theirs.fetchall()), key=repr)


def test_all_queries_have_sql():
    assert set(core.queries()) == set(core.oracle_sql())


def test_live_counts(spark, sf_dir):
    counts = {r["status"]: r["n"] for r in core.queries()["count_by_status"](spark, sf_dir).collect()}
    assert counts == {"LIVE": 12, "DELETED": 3}


def test_key_bounds_reach_the_scan_and_liveness_stays_above(spark, tmp_path):
    from keystrata.operators import scan

    path = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 0, 0, 0, "x")], "key string, segment_id bigint, pos bigint, rtype int, expires_ns bigint, value string").write.parquet(path)
    plan = scan.scan_range(spark.read.parquet(path), "a", "b", 5)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "GreaterThanOrEqual(key,a)" in pushed and "LessThan(key,b)" in pushed
    assert "rtype" not in pushed
