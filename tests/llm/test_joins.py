"""The prefix-tree join, components, decontamination and licences against plain versions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import decontam, licenses, ngram_join
from millrace.llm.components import components


def groups_of(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@given(st.data())
@settings(max_examples=80, deadline=None)
def test_trie_join_connects_what_links_connect(data):
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    num, den = data.draw(st.sampled_from([(8, 10), (90, 100), (1, 2), (1, 1)]))
    bases = [set(rng.sample(range(300), rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
    sets = []
    for _ in range(rng.randint(2, 25)):
        x = set(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            x ^= {rng.randrange(300)}
        sets.append(x or {1})
    other = None if rng.random() < 0.5 else np.array([rng.random() < 0.5 for _ in sets])
    want = [(i, j) for i in range(len(sets)) for j in range(i) if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and (other is None or other[i] != other[j])]
    got = ngram_join.trie_join([np.array(sorted(x), np.uint64) for x in sets], np.array([len(x) for x in sets]), num, den, other)
    assert all((max(p), min(p)) in want for p in got)
    assert groups_of(len(sets), got) == groups_of(len(sets), want)


def brute(rows, n, num, den):
    """Sizes and components by comparing every two documents."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    return {i: (len(s), rows[c][0]) for (i, _), s, c in zip(rows, sets, groups_of(len(sets), links))}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(1, 120))] for _ in range(12)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for k in range(n):
        x = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            x[rng.randrange(len(x))] = rng.choice(words)
        if rng.random() < 0.2:
            x = [rng.choice(words) for _ in range(60)] + passage
        out.append((k, rng.choice([" ", "\t", " \n"]).join(x).capitalize()))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One"), (n + 4, "one"), (n + 5, "one two"), (n + 6, "É é"), (n + 7, "é é")]


@pytest.mark.parametrize("seed,n,num,den", [(1, 3, 90, 100), (2, 5, 8, 10), (3, 1, 1, 2)])
def test_near_duplicates_equal_brute_force(spark, seed, n, num, den):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df, n, num, den).collect()}
    assert got == brute(rows, n, num, den)


def test_large_groups_are_joined_in_blocks(spark):
    rng = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        x = list(base)
        x[rng.randrange(60)] = f"z{rng.randrange(5)}"
        x[rng.randrange(60)] = f"z{rng.randrange(5)}"
        rows.append((k, " ".join(x)))
    counts = ngram_join.shingle_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3)
    blocks = counts.select("block").distinct()
    classes = ngram_join.set_keys(blocks).groupBy("key").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
    groups = ngram_join.candidate_groups(ngram_join.prefix_tokens(counts, 90, 100), classes)
    for size in (1000, 7):
        links = ngram_join.class_links(blocks, groups, 90, 100, size)
        ends = {r["node"]: r["component"] for r in components(links).collect()}
        reps = {r["doc_id"]: r["doc_id"] for r in ngram_join.set_keys(blocks).collect()}
        want = brute(rows, 3, 90, 100)
        firsts = {r["rep"] for r in classes.collect()}
        assert {i: ends.get(i, i) for i in reps if i in firsts} == {i: want[i][1] for i in firsts}


def test_bands_of_sizes_lose_no_link(spark):
    """A hot passage in sets of all sizes: cut into bands and blocks, whatever the block size."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(150):
        x = base[: rng.randint(40, 400)]
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = f"z{rng.randrange(9)}"
        rows.append((k, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for n, num, den in ((3, 90, 100), (5, 8, 10), (1, 1, 1)):
        counts = ngram_join.shingle_counts(df, n)
        blocks = counts.select("block").distinct()
        keys = ngram_join.set_keys(blocks)
        classes = keys.groupBy("key").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
        groups = ngram_join.candidate_groups(ngram_join.prefix_tokens(counts, num, den), classes)
        firsts = {r["rep"] for r in classes.collect()}
        want = brute(rows, n, num, den)
        for size in (1000, 5, 1):
            ends = {r["node"]: r["component"] for r in components(ngram_join.class_links(blocks, groups, num, den, size)).collect()}
            assert {i: ends.get(i, i) for i in firsts} == {i: want[i][1] for i in firsts}


def test_repeated_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text), (5, text), (2, text), (None, text), (None, "x y z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2), (5, 2), (2, 2), (None, 2), (None, None)], key=str)
    assert ngram_join.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 120)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = groups_of(121, links)
    touched = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEM = "If Maria has 12 apples and buys 30 apples from Paul then how many apples does Maria own now?"


def test_decontamination(spark):
    rows = [
        (1, f"Before it. {ITEM} After it."), (2, ITEM.replace("Maria", "John").replace("12", "7").replace("30", "9")), (3, ITEM.upper()), (4, ITEM.replace("Maria own", "Paul own")),
        (5, None), (6, ""), (7, "how many apples does she own"), (8, " | ".join(ITEM.split())), (9, "Tiny item here now"), (10, "word " * 40 + ITEM + " word" * 40), (None, ITEM),
    ]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, place long")
    items = spark.createDataFrame([(50, ITEM), (51, "tiny item here now"), (52, None), (53, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in decontam.contaminated(docs, items).collect()}
    assert got == {(1, 50): True, (2, 50): False, (3, 50): True, (8, 50): True, (9, 51): True, (10, 50): True}
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_finds_all_whole_passages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    norm = lambda t: f" {' '.join(re.findall(r'[^\W\d_]+|\d+', (t or '').lower()))} "
    texts = [(d["doc_id"], norm(d["text"])) for d in docs.collect()]
    want = {(i, b["item_id"]) for b in items.collect() for i, t in texts if norm(b["text"]) in t}
    assert want and {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()} == want


def test_licenses(spark):
    known = dict(reversed(licenses.known_texts()))
    mit = known["MIT"]
    rows = [
        (1, "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.upper()), (2, "text before\nReleased under the MIT licence!\ntext after"), (3, mit + " and more"), (4, None), (5, ""),
        (6, "we like the MIT License here"), (7, "Licensed under CC BY-NC 4.0.\nx\nlicensed under  cc-by-nc 4.0"), (8, "Copyright 2020 Nobody"), (None, "SPDX-License-Identifier: MIT"),
    ]
    got = {(r["doc_id"], r["license"], r["unit"]): r["n"] for r in licenses.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")).collect()}
    assert got == {(1, "MIT", "document"): 1, (2, "MIT", "line"): 1, (7, "CC-BY-NC-4.0", "line"): 2, (None, "MIT", "document"): 1}
    assert len({licenses.digest(t) for _, t in licenses.known_texts()}) >= len(licenses.known_texts()) - 8
    for name, text in licenses.known_texts():
        assert licenses.digest("  " + text.replace("License", "LICENCE").replace(" ", "\n") + "\n© 2001 A") == licenses.digest(text), name
