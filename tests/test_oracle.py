"""Every query with SQL gives what DuckDB gives; the others give rows."""

import glob
import math
import os

import duckdb
import pytest

from conceptloom.plans import queries as Q

from .conftest import DATA


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    def cell(x):
        return None if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, float) else str(x)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(str([cell(r[k]) for k in order]) for r in data)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, DATA)
    got = duck.execute(Q.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_rows_only(spark, name):
    assert Q.QUERIES[name](spark, DATA).count() > 0
