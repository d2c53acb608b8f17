"""Every registered query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quern.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in os.listdir(data):
        c.execute(f"create view {p.split('.')[0]} as select * from '{data}/{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v if isinstance(v, (int, bool, str, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert rows
        return
    r = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
