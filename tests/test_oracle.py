"""Every query with SQL gives the rows DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from citeloom.plans import catalog


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_duckdb(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = db.execute(catalog.SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    want = sorted((tuple(norm(r[have.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns
    df.count()
