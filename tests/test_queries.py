"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tablewright.plans import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{name}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got, columns = df.collect(), df.columns
    result = duck.execute(SQL[name])
    wanted_columns = [c[0] for c in result.description]
    wanted = result.fetchall()
    assert sorted(columns) == sorted(wanted_columns)
    order = sorted(columns)
    pick = lambda data, names: sorted(tuple(repr(r[names.index(c)]) for c in order) for r in data)
    assert pick(got, columns) == pick(wanted, wanted_columns)
