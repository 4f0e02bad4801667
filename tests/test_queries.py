"""Every registered query runs on the smallest tables, and equals its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)
    return x == y


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    sql = catalogue.ORACLE_SQL.get(name)
    if sql is None:
        assert got or name == "girvan_newman"
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in found.fetchall()]
    key = lambda r: tuple(str(round(x, 3)) if isinstance(x, float) else str(x) for x in r)
    assert len(got) == len(want)
    assert all(_same(a, b) for x, y in zip(sorted(got, key=key), sorted(want, key=key)) for a, b in zip(x, y))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
