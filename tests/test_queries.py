"""Each registered scan query against its SQL on the smallest tables, when they are there."""

import os

import duckdb
import pytest

from sieveline.plans import catalog

DATA = "/root/testdata/sf0.01"
TABLES = ("documents", "pages", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    assert rows
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert rows == sorted(repr([_plain(x) for x in r]) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
