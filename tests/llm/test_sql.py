"""The corpus queries that SQL can express against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from keystrata.llm import queries as llm


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in ("documents", "benchmark"):
        p = f"{sf_dir}/{f}.parquet"
        c.execute(f"CREATE VIEW {f} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    frame = llm.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    theirs = duck.sql(llm.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    place = [theirs.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in place) for r in theirs.fetchall()), key=repr)
