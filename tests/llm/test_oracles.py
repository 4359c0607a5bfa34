"""Queries of the subpackage against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from epochflow.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)
    assert len(got) > 0
    assert got == sorted(cur.fetchall(), key=str)
