"""Counting shared members in tasks that stay small, against plain counting."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import graph, pairs, similarity

TWIST = 1 << 40


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def members(spark):
    """Repeated rows, owners beyond 32 bits, rows without a member or an owner."""
    rng = np.random.default_rng(11)
    some = [(int(o) - 20, int(m)) for o, m in zip(rng.integers(0, 60, 900), rng.integers(0, 90, 900))]
    some += [(TWIST + k, m) for k in (0, 5) for m in range(8)] + [(3, m) for m in range(8)] + [(3, None), (4, None), (3, None), (None, 2)]
    return some, spark.createDataFrame(some + some[:100], "o long, m long")


def plain(some):
    owners = {}
    for o, m in set(some):
        if o is not None:
            owners.setdefault(o, set()).add(m)
    return owners, {(a, b): n for a, b in combinations(sorted(owners), 2) if (n := len((owners[a] & owners[b]) - {None}))}


@pytest.mark.parametrize("chunk, piece, task, held", [(1 << 18, 1 << 21, 1 << 23, 1 << 25), (7, 5, 50, 20)])
def test_shared_members_are_counted_in_pieces_of_any_size(spark, members, monkeypatch, chunk, piece, task, held):
    for name, value in (("CHUNK", chunk), ("SLICE", piece), ("TASK", task), ("HELD", held)):
        monkeypatch.setattr(pairs, name, value)
    some, df = members
    owners, want = plain(some)
    found = pairs.lists(df)
    assert found.most == max(Counter(m for o, m in set(some) if o is not None and m is not None).values())
    assert rows(pairs.rows_of(found)) == sorted({(o, m) for o, m in some if o is not None and m is not None})
    assert {(a, b): k for a, b, k in rows(pairs.shared(found, 1))} == want
    both = rows(pairs.shared(found, 2, 0.2, sizes=True))
    assert {a: k for a, b, k in both if a == b} == {o: len(s) for o, s in owners.items()}
    assert {(a, b): k for a, b, k in both if a < b} == {(a, b): k for (a, b), k in want.items() if k >= max(2, len(owners[a]) * 0.2)}


def test_tasks_hold_no_more_when_there_is_more_input(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TASK", 1000)
    for copies in (1, 4):
        df = spark.range(copies * 2000).select((F.col("id") % (copies * 200)).alias("o"), (F.col("id") % (copies * 200) % (copies * 20)).alias("m"))
        found = pairs.lists(df)
        assert found.pairs == copies * 900
        assert pairs.shared(found, 1).rdd.getNumPartitions() <= max(copies, spark.sparkContext.defaultParallelism)


def test_pairs_are_counted_once_and_shuffle_no_pair_as_a_row(spark, members):
    """Edges are a table of their own, so their users do not count again; before, the count was in the plan of every use."""
    edges = graph.cooccurrence_edges(members[1], "o", "m", 3)
    plan = edges._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "MapInArrow" not in plan


def test_owners_keep_their_type(spark, members):
    df = members[1].where("o < 100")
    for kind in ("int", "string"):
        typed = df.select(F.col("o").cast(kind), "m")
        found = similarity.jaccard_pairs(typed, "o", "m", 0.1)
        assert found.schema["a"].dataType.simpleString() == kind
        assert len(rows(found)) == len(rows(similarity.jaccard_pairs(df, "o", "m", 0.1))) > 0


@pytest.mark.parametrize("threshold, least", [(0.05, 1), (0.1, 3)])
def test_lsh_compares_signatures_of_the_pairs_that_reach_the_threshold(spark, members, monkeypatch, threshold, least):
    """The same pairs as LSH candidates checked one by one, and no table of candidates."""
    some, df = members
    df = df.where("m is not null")
    owners, shared = plain([r for r in some if r[1] is not None])
    agree = set(rows(similarity.lsh_candidates(df, "o", "m", 5)))
    assert agree <= set(shared)
    reach = {p: k / (len(owners[p[0]]) + len(owners[p[1]]) - k) for p, k in shared.items() if k >= least}
    want = {p: s for p, s in reach.items() if s >= threshold and p in agree}
    for hot in (2000, 0):
        monkeypatch.setattr(similarity, "HOT", hot)
        assert {(a, b): s for a, b, s in rows(similarity.lsh_pairs(df, "o", "m", 5, threshold, least))} == pytest.approx(want)
    monkeypatch.setattr(similarity, "HOT", 2000)
    monkeypatch.setattr(similarity, "lsh_candidates", None)
    hits = rows(similarity.lsh_hits(df, "o", "m", 5, threshold, least))
    assert {(a, b) for a, b, _, hit in hits if hit} == set(want) and len(hits) == sum(s >= threshold for s in reach.values())
