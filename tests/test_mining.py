"""Itemsets, similarity, recommendation, graphs, sketches and clustering against plain versions."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import cluster, graph, itemsets, recommend, similarity, sketch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_itemsets_of_sets(spark):
    rng = random.Random(1)
    baskets = {str(b): {rng.choice("abcdef") for _ in range(4)} for b in range(40)}
    pairs = spark.createDataFrame([(b, i) for b, s in baskets.items() for i in [*s, min(s)]], "basket string, item string")
    want = sorted((list(c), n) for k in (1, 2, 3, 4) for c in combinations("abcdef", k) if (n := sum(set(c) <= s for s in baskets.values())) >= 8)
    assert sorted((r["items"], r["freq"]) for r in itemsets.frequent_itemsets(pairs, 8).collect()) == want
    candidates = itemsets.son_candidates(pairs, 8, 3)
    assert {tuple(c) for c, _ in want} <= {tuple(sorted(r[0])) for r in candidates.collect()}
    assert sorted((sorted(r["items"]), r["freq"]) for r in itemsets.count_itemsets(pairs, candidates, 8).collect()) == want
    assert itemsets.frequent_itemsets(pairs.limit(0), 8).count() == 0


@given(st.lists(st.frozensets(st.sampled_from("abcde"), max_size=4), max_size=12), st.integers(1, 4))
@settings(max_examples=60, deadline=None)
def test_apriori_is_closed_downwards(baskets, support):
    found = itemsets.apriori(baskets, support)
    assert all(s in found for c in found for s in combinations(c, len(c) - 1) if s)
    assert all(sum(set(c) <= b for b in baskets) >= support for c in found)


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(2)
    data = {(rng.randrange(12), rng.randrange(10)): float(rng.randrange(1, 6)) for _ in range(80)}
    return data, spark.createDataFrame([(u, i, r) for (u, i), r in data.items()], "user long, item long, stars double")


def test_jaccard_and_lsh(rated, monkeypatch):
    data, df = rated
    users = defaultdict(set)
    for u, i in data:
        users[i].add(u)
    want = {(a, b): len(users[a] & users[b]) / len(users[a] | users[b]) for a, b in combinations(sorted(users), 2) if users[a] & users[b]}
    got = {(a, b): s for a, b, s in rows(similarity.jaccard_pairs(df, "item", "user", 0.2))}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.2})
    near = {(a, b): s for a, b, s in rows(similarity.lsh_pairs(df, "item", "user", 20, 0.2))}
    assert near.items() <= got.items()
    assert set(near) == set(rows(similarity.lsh_candidates(df, "item", "user", 20))) & set(got)
    monkeypatch.setattr(similarity, "ARRAY", 2)
    assert {(a, b): s for a, b, s in rows(similarity.lsh_pairs(df, "item", "user", 20, 0.2))} == near


def test_pearson(rated):
    data, df = rated
    by = defaultdict(dict)
    for (u, i), r in data.items():
        by[i][u] = r
    want = {}
    for a, b in combinations(sorted(by), 2):
        both = sorted(by[a].keys() & by[b].keys())
        if len(both) >= 3:
            x, y = (np.array([by[k][u] for u in both]) for k in (a, b))
            x, y = x - x.mean(), y - y.mean()
            if (x @ x) > 1e-9 and (y @ y) > 1e-9 and x @ y > 1e-9:
                want[a, b] = x @ y / math.sqrt((x @ x) * (y @ y))
    assert {(a, b): s for a, b, s in rows(similarity.pearson_pairs(df, "item", "user"))} == pytest.approx(want)


def test_predictions(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0), (2, 3, 3.0)], "user long, item long, stars double")
    tests = spark.createDataFrame([(1, 3), (9, 3), (1, 8)], "user long, item long")
    items = spark.createDataFrame([(1, 3, 0.5), (2, 3, 0.25)], "a long, b long, sim double")
    assert rows(recommend.predict_by_items(train, tests, items)) == [(1, 3, pytest.approx((4 * 0.5 + 2 * 0.25) / 0.75))]
    users = spark.createDataFrame([(1, 2, 0.5)], "a long, b long, sim double")
    assert rows(recommend.predict_by_users(train, tests, users)) == [(1, 3, pytest.approx(3.0 - 1.0)), (1, 8, 3.0)]


def test_profiles(spark):
    texts = spark.createDataFrame([(1, "x", "cat cat dog 12"), (1, "y", "Dog, bird!"), (2, "y", ""), (2, "z", None)], "user long, business string, text string")
    profile = recommend.tfidf_profile(texts, ["the"])
    got = {(b, w): (f, t) for b, w, f, t in rows(profile)}
    assert got[("x", "cat")] == (2, round(math.log2(3), 6)) and got[("x", "dog")] == (1, round(0.5 * math.log2(1.5), 6)) and len(got) == 4
    users = recommend.user_profile(texts, profile)
    assert rows(users.where("user = 1")) == [(1, "bird", 1), (1, "cat", 2), (1, "dog", 2)]
    assert rows(recommend.content_score(texts, users, profile)) == [(1, "x", 1.0), (1, "y", 1.0), (2, "y", 1.0)]


def _random_graph(seed, n=14, p=0.2):
    rng = random.Random(seed)
    return [(a, b) for a, b in combinations(range(n), 2) if rng.random() < p]


def _betweenness(edges):
    adjacency = defaultdict(set)
    for a, b in edges:
        adjacency[a].add(b)
        adjacency[b].add(a)
    total = Counter()
    for s, t in combinations(sorted(adjacency), 2):
        level, best = [[s]], []
        seen = {s}
        while level and not best:
            best = [p for p in level if p[-1] == t]
            seen |= {p[-1] for p in level}
            level = [p + [x] for p in level for x in adjacency[p[-1]] if x not in seen]
        for p in best:
            for a, b in zip(p, p[1:]):
                total[min(a, b), max(a, b)] += 1 / len(best)
    return dict(total)


@pytest.mark.parametrize("edges", [[(0, 1)], [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)], _random_graph(5)])
def test_betweenness_both_ways(spark, edges):
    df, want = spark.createDataFrame(edges, "a long, b long"), _betweenness(edges)
    assert {(a, b): v for a, b, v in rows(graph.edge_betweenness(df))} == pytest.approx(want)
    assert {(a, b): v for a, b, v in rows(graph.edge_betweenness(df, small=0))} == pytest.approx(want)


def test_components_labels_and_modularity(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3), (8, 9)]
    df = graph.edges_of(spark.createDataFrame([(b, a) for a, b in edges] + [(7, 7), (None, 1), (1, 0)], "x long, y long"), "x", "y")
    assert rows(df) == sorted(edges)
    assert rows(graph.connected_components(df)) == [(k, 0) for k in range(6)] + [(8, 8), (9, 8)]
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {c for _, c in rows(graph.connected_components(chain))} == {0}
    labels = dict(rows(graph.label_propagation(df, 5)))
    assert set(labels) == {0, 1, 2, 3, 4, 5, 8, 9} and labels[0] == labels[1] == labels[2]
    split = spark.createDataFrame([(k, 0 if k < 3 else 1 if k < 6 else 2) for k in (0, 1, 2, 3, 4, 5, 8, 9)], "node long, community long")
    want = sum((2 * e - d * d / 16) / 16 for e, d in ((3, 7), (3, 7), (1, 2)))
    assert graph.modularity(df, split).first()[0] == pytest.approx(want)


def test_girvan_newman_small_and_distributed_agree(spark):
    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (2, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)]
    assert rows(graph.girvan_newman(df)) == want
    assert rows(graph.girvan_newman(df, small=0)) == want
    assert rows(graph.girvan_newman(df.limit(0))) == []
    assert rows(graph.girvan_newman(df.limit(1))) == []


def test_bloom_has_no_false_negatives(spark):
    names = spark.createDataFrame([(f"name {k}",) for k in range(50)] + [("",), (None,), ("Zoë",)], "name string")
    bits = sketch.bloom_bits(names)
    assert all(r["present"] for r in sketch.bloom_probe(names, bits).collect())
    other = spark.createDataFrame([("another",), ("",), (None,)], "name string")
    assert Counter(r["present"] for r in sketch.bloom_probe(other, bits).collect()) == {True: 2, False: 1}


def test_flajolet_martin(spark):
    values = [f"v{k}" for k in range(12)]
    most = []
    for a, b, p in zip(sketch.FM_A, sketch.FM_B, sketch.FM_P):
        hashes = [bin((a * int(v.encode().hex(), 16) + b) % p % sketch.BLOOM_BITS) for v in values]
        most.append(max(len(h) - len(h.rstrip("0")) for h in hashes))
    for form, each in (("square", [r * r for r in most]), ("power", [2**r for r in most])):
        means = sorted(sum(each[i : i + 5]) / 5 for i in range(0, 35, 5))
        got = sketch.fm_estimate(spark.createDataFrame([(v,) for v in values * 2], "v string"), "v", form=form).first()
        assert tuple(got) == (12, pytest.approx(means[3]))
    assert sketch.fm_estimate(spark.createDataFrame([], "v string"), "v").count() == 0


def test_reservoir_and_frequencies(spark):
    df = spark.range(1000)
    sample = [r[0] for r in sketch.reservoir(df, "id", 100).collect()]
    assert len(set(sample)) == 100 and 350 < sum(sample) / 100 < 650
    assert sketch.reservoir(df.limit(7), "id", 100).count() == 7
    tags = spark.createDataFrame([(t,) for t in "aaabbbccdde"], "tag string")
    assert rows(sketch.top_frequencies(tags, "tag", 2)) == [("a", 3), ("b", 3), ("c", 2), ("d", 2)]


def _points(spark, seed=0, n=120, dims=3, k=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (n, dims)) + (np.arange(n) % k)[:, None] * 10
    return x, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")


def test_kmeans(spark):
    x, df = _points(spark)
    centres = x[:3].copy()
    for _ in range(20):
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([x[at == k].mean(0) for k in range(3)])
    assert [r["cluster"] for r in cluster.kmeans(df, 3).orderBy("id").collect()] == at.tolist()
    same = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [5.0, 1.0])], "id long, features array<double>")
    assert [r["cluster"] for r in cluster.kmeans(same, 2).orderBy("id").collect()] == [0, 0, 1]


def test_cluster_stats(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 4.0]), (1, [5.0, 6.0])], "cluster int, features array<double>")
    assert rows(cluster.cluster_stats(df)) == [(0, 2, [4.0, 6.0], [10.0, 20.0]), (1, 1, [5.0, 6.0], [25.0, 36.0])]


def test_bfr_counts_every_point_in_every_round(spark):
    x, df = _points(spark, 3, 300)
    parts = [df.where(f"id % 3 = {k} or {k} = 9") for k in range(3)]
    parts = [df.where(f"id >= {100 * k} and id < {100 * k + 100}") for k in range(3)]
    found, counters = cluster.bfr(parts, 3, 3)
    assert [c["ds_points"] + c["cs_points"] + c["rs_points"] for c in counters] == [100, 200, 300]
    labels = {r["id"]: r["cluster"] for r in found.collect()}
    assert sorted(labels) == list(range(300))
    groups = [{labels[i] for i in range(300) if i % 3 == k} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.8])
def test_hot_members_change_no_result(spark, monkeypatch, threshold):
    """Prefixes find what counting all pairs finds, with a member that everybody has and owners beyond the array size."""
    rng = np.random.default_rng(3)
    pairs = {(o, int(m)) for o in range(60) for m in rng.choice(30, rng.integers(1, 12), replace=False)} | {(o, 99) for o in range(60)} | {(7, m) for m in range(100, 140)}
    df = spark.createDataFrame(sorted(pairs), "o long, m long")
    ratings = df.select(F.col("o").alias("item"), F.col("m").alias("user"), (F.col("o") * F.col("m") % 5).cast("double").alias("stars"))
    for hot, array in ((10**6, 10_000), (0, 10_000), (0, 20)):
        monkeypatch.setattr(similarity, "HOT", hot)
        monkeypatch.setattr(similarity, "ARRAY", array)
        got = [rows(similarity.jaccard_pairs(df, "o", "m", threshold)), rows(graph.cooccurrence_edges(df, "o", "m", 4)), [(a, b, round(s, 9)) for a, b, s in rows(similarity.pearson_pairs(ratings, "item", "user"))]]
        if hot:
            want = got
        assert got == want and all(want[1:])


def test_betweenness_matrices_equal_the_walk():
    rng = np.random.default_rng(5)
    for n, p in ((3, 1.0), (12, 0.3), (40, 0.1), (40, 0.6)):
        links = np.triu(rng.random((n, n)) < p, 1)
        links = (links | links.T).astype(float)
        adjacency = {i: np.flatnonzero(links[i]).tolist() for i in range(n)}
        want = np.zeros((n, n))
        for root in range(n):
            for (a, b), flow in graph.shares_from(root, adjacency).items():
                want[a, b] += flow / 2
        assert np.allclose(np.triu(graph.matrix_flows(links)), want)


def test_random_start_of_kmeans(spark):
    x, df = _points(spark, 4)
    start = cluster.random_points(df, 3, seed=1)
    assert len({tuple(r) for r in start}) == 3 and all(any(np.allclose(r, p) for p in x) for r in start)
    assert not np.allclose(start, cluster.random_points(df, 3, seed=2))
    found = {r["id"]: r["cluster"] for r in cluster.kmeans(df, 3, seed=8).collect()}
    assert len(found) == len(x)


def test_nearest_centres_by_products_are_those_by_differences():
    """Ties, points far from the origin and centres that differ by a bit."""
    rng = np.random.default_rng(6)
    for shift in (0.0, 1e6):
        centres = rng.normal(size=(5, 4)) + shift
        centres[3] = centres[1]
        centres[4] = np.nextafter(centres[2], np.inf)
        x = np.concatenate([rng.normal(size=(300, 4)) + shift, centres, (centres[:1] + centres[1:]) / 2])
        assert cluster.nearest_centres(x, centres)[0].tolist() == cluster._assigner(centres)(x)[0].tolist()


def test_kmeans_reads_its_points_once(spark, monkeypatch):
    """Rounds read blocks; before, every round turned all rows into Python objects again."""
    monkeypatch.setattr(cluster, "BLOCK", 16)
    x, df = _points(spark, 7)
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    start = cluster.first_points(df, 3)
    found = cluster.lloyd(df.mapInPandas(seen, df.schema), 3, 50, start)
    assert read.value == len(x)
    assert np.allclose(found, [x[np.arange(120) % 3 == k].mean(0) for k in range(3)])


def test_first_points_after_many_copies(spark):
    copies = spark.createDataFrame([(i, [1.0 if i < 200 else float(i)]) for i in range(210)], "id long, features array<double>")
    assert cluster.first_points(copies, 3).tolist() == [[1.0], [200.0], [201.0]]
    assert cluster.first_points(copies.limit(100), 3).tolist() == [[1.0]]


def test_rounds_on_points_between_centres_are_rounds_over_all(spark, monkeypatch):
    """Few passes, and after any number of rounds the centres of a plain Lloyd."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>").repartition(3)
    monkeypatch.setattr(cluster, "BLOCK", 200)
    monkeypatch.setattr(cluster, "NEAR", 400 * 8 * 4)
    passes, plain = [], cluster._pass
    monkeypatch.setattr(cluster, "_pass", lambda *args: passes.append(1) or plain(*args))
    blocks = cluster._blocks(df)
    centres, rounds = x[:5].copy(), 0
    while True:
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        moved = np.stack([x[at == c].mean(0) for c in range(5)])
        rounds += 1
        if rounds == 12:
            assert np.allclose(cluster.lloyd(df, 5, 12, x[:5], blocks=blocks), moved, rtol=0, atol=1e-11)
        if np.abs(moved - centres).max() <= 1e-12:
            break
        centres = moved
    passes.clear()
    assert np.allclose(cluster.lloyd(df, 5, 10_000, x[:5], settle=True, blocks=blocks), centres, rtol=0, atol=1e-11)
    assert len(passes) < rounds / 2


def test_profiles_take_texts_apart_once(spark):
    """Before, every use of the word counts read all texts again."""
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    texts = spark.createDataFrame([(1, "x", "cat cat dog"), (1, "y", "dog bird"), (2, "y", "owl")], "user long, business string, text string")
    profile = recommend.tfidf_profile(texts.mapInPandas(seen, texts.schema), ["the"])
    assert len(rows(profile)) == 5
    assert read.value == 3
