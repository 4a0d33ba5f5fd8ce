"""The llm queries with SQL give DuckDB's rows on the same tables."""

from pathlib import Path

import pytest

pytest.importorskip("citeloom.llm")

import duckdb  # noqa: E402

from citeloom.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_duckdb(spark, sf, name):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(queries.SQL[name])
    have = [c[0] for c in cur.description]
    assert sorted(have) == cols
    want = sorted(tuple(r[have.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want and want
