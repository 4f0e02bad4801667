"""Every training-data query on the smallest tables; those with SQL twins against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.llm import queries


def test_one_query_an_operator():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(names) <= set(entry.queries()) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    table, key = ("pages", "page_id") if name == "op9_warc" else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    seen = [r[columns.index(key)] for r in got]
    if name in ("op6_licenses", "op7_decontamination"):
        assert set(seen) <= ids
    else:
        assert sorted(seen) == sorted(ids)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for t in ("documents", "pages"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(queries.ORACLE_SQL[name])
        order = [found.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=str)
