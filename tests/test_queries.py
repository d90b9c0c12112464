"""Every query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidegrid.plans import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(df):
    cell = lambda x: "null" if x is None or x != x else format(x, ".9g") if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, name):
    got = Q.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
