"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from epochflow.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(v) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, cur.fetchall())
    assert len(got) == len(want) and len(want) > 0
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_finite_rows(spark, name):
    """Queries beyond SQL: rows, none of them with a missing or infinite number. test_numpy.py holds their values."""
    import math

    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert rows

    def sound(v):
        return not isinstance(v, float) or math.isfinite(v)

    for r in rows:
        assert all(sound(x) for v in r for x in (v if isinstance(v, list) else [v])), r
