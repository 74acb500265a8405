"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltscreen.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "pages", "conversations", "events", "benchmark"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    return round(value, 6) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracle.statements())
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted((tuple(normal(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["source", "total_requests"] and df.count() > 0
