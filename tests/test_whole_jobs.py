"""Queries read every row, and equal their SQL twins without the twins' row filters."""

import duckdb
import numpy as np
import pytest

from millrace.operators import cluster
from millrace.plans import catalogue
from millrace.plans.settings import K_MEANS
from millrace.sources import views

SF = "/root/testdata/sf0.01"


def got(spark, name):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect())


def twin(name, without):
    """Rows of the query's SQL with the texts of ``without`` left out."""
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in ("events", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return sorted(con.sql(catalogue.ORACLE_SQL[name].replace(without, "")).fetchall())


def same(found, want):
    assert [r[:-1] for r in found] == [r[:-1] for r in want]
    assert [r[-1] for r in found] == pytest.approx([r[-1] for r in want], abs=2e-6)


@pytest.mark.parametrize("name", ["fm_reference", "fm_standard"])
def test_distinct_counts_of_all_days(spark, name):
    found = got(spark, name)
    assert len(found) == 30
    same(found, twin(name, "day(ts) <= 7 AND "))


def test_sketched_distinct_counts_of_all_days(spark):
    exact = dict(duckdb.sql(f"SELECT strftime(ts, '%Y-%m-%d'), count(DISTINCT user_id) FROM '{SF}/events.parquet' GROUP BY 1").fetchall())
    found = dict(got(spark, "hll_distinct"))
    assert len(found) == 30 and found.keys() == exact.keys()
    assert all(abs(n - exact[day]) <= 0.1 * exact[day] for day, n in found.items())


@pytest.mark.parametrize("name", ["content_score", "content_cosine"])
def test_scores_of_all_users(spark, name):
    found = got(spark, name)
    assert {r[0] for r in found} == set(range(50))
    same(found, twin(name, " WHERE doc_id % 10 = 0"))


def plain_lloyd(x, k):
    """Clusters and rounds of Lloyd from the first different points until no centre moves."""
    centres = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:k]]
    for n in range(1, 1000):
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.stack([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(k)])
        if np.allclose(moved, centres, rtol=0, atol=1e-12):
            return at, np.sqrt(((x - centres[at]) ** 2).sum(1)), n
        centres = moved


def test_kmeans_runs_until_it_settles(spark):
    points = sorted(views.points(spark, SF).collect())
    at, far, rounds = plain_lloyd(np.array([r[1] for r in points]), K_MEANS)
    assert rounds > 5
    same(got(spark, "kmeans"), list(zip([r[0] for r in points], at.tolist(), far.tolist())))


def test_kmeans_that_does_not_settle_fails(spark):
    with pytest.raises(RuntimeError):
        cluster.kmeans(views.points(spark, SF), K_MEANS, 3)


def test_user_predictions_are_rounded_as_in_sql(spark, tmp_path):
    """Two users whose prediction is 1.5943749999999999, a half in the sixth digit but for the last bit."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet' WHERE o_custkey IN (321, 1286)")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
    for t in ("orders", "lineitem"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = sorted(tuple(r) for r in catalogue.QUERIES["user_cf_predict"](spark, str(tmp_path)).collect())
    assert (321, 1890, 1.59438) in found
    assert found == sorted(con.sql(catalogue.ORACLE_SQL["user_cf_predict"]).fetchall())
