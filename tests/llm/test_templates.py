"""Re-parameterised benchmark items: random names of one to three words, random numbers, units."""

import random

import pytest

from millrace.llm import decontam

ITEM = "Every morning Maria has 12 apples and buys 30 apples from Paul before they count how many apples Maria owns."


def pairs(found):
    return {(r["doc_id"], r["item_id"]) for r in found.collect()}


def check(spark, docs, items, want):
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert pairs(got) == want


def test_names_of_other_lengths_and_equal_numbers(spark):
    docs = [
        (1, ITEM), (2, ITEM.replace("Maria", "Mary Ann").replace("Paul", "Juan Carlos")), (3, ITEM.replace("12", "30")), (4, ITEM.replace("Maria", "Anna Lee Smith").replace("12", "7").replace("30", "7")),
        (5, ITEM.replace("Maria owns", "Paul owns")), (6, "Then " + ITEM.replace("Paul", "Maria")), (7, "Well, " + ITEM.lower()), (8, ITEM.replace("apples", "pears")),
    ]
    check(spark, docs, [(1, ITEM)], {(k, 1) for k in (1, 2, 3, 4, 7)})


SYLLABLES = ["ba", "ko", "lim", "ter", "sun", "ra", "vo", "mil", "zen", "dar", "pel", "quo", "nis", "gra", "fo"]


def make(rng):
    """A template of words and slots, as a list, and values for its slots."""
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))
    kind = rng.random()
    n_names, n_numbers = (rng.randint(1, 3), rng.randint(1, 4)) if kind < 0.6 else (0, rng.randint(3, 12)) if kind < 0.8 else (rng.randint(1, 2), rng.randint(4, 10))
    parts = [word() for _ in range(rng.randint(18, 40))]
    for k in range(n_names):
        for _ in range(rng.randint(1, 2)):
            parts.insert(rng.randint(1, len(parts)), ("name", k))
    start = rng.randint(1, len(parts))
    for k in range(n_numbers):
        at = start if kind >= 0.6 else rng.randint(1, len(parts))
        parts.insert(at, ("number", k))
    # two names beside each other would be one name
    return [p for i, p in enumerate(parts) if not (i and isinstance(p, tuple) and p[0] == "name" and isinstance(parts[i - 1], tuple) and parts[i - 1][0] == "name")]


def fill(rng, parts):
    names = rng.sample([a.capitalize() + b for a in SYLLABLES for b in SYLLABLES], 30)
    values: dict = {}
    out = []
    for p in parts:
        if isinstance(p, tuple):
            if p not in values:
                values[p] = " ".join(names.pop() for _ in range(rng.randint(1, 3))) if p[0] == "name" else str(rng.choice([rng.randint(1, 20), round(rng.random() * 100, 1), rng.randint(1000, 10**6)]))
            p = values[p]
        out.append(p)
    text = " ".join(out)
    return text[0].upper() + text[1:] + "."


@pytest.mark.parametrize("seed", range(3))
def test_all_re_parameterised_items_are_found(spark, seed):
    rng = random.Random(seed)
    templates = [make(rng) for _ in range(60)]
    items = [(k, fill(rng, t)) for k, t in enumerate(templates)]
    around = lambda: " ".join("".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(rng.randint(0, 30)))
    docs, want = [], set()
    for k, t in enumerate(templates):
        for text in (items[k][1], fill(rng, t), items[k][1].upper()):
            docs.append((len(docs), f"{around()}. {text} {around()}".strip(" .")))
            want.add((docs[-1][0], k))
    docs += [(1000 + k, fill(rng, make(rng))) for k in range(100)]
    check(spark, docs, items, want)


def test_null_ids_are_not_named_and_repeated_ids_are_judged_alone(spark):
    half = ITEM.split()
    docs = [(None, ITEM), (1, " ".join(half[:9])), (1, " ".join(half[9:])), (2, ITEM), (2, "other words"), (3, None)]
    check(spark, docs, [(1, ITEM), (None, ITEM), (4, ITEM), (5, None)], {(2, 1), (2, 4)})


def test_names_that_go_on_outside_a_copy(spark):
    """The first and last word of a copy may stand beside other capitalised words."""
    item = ITEM.replace("Every", "Maria and every").replace(" they count", " Anna counts") + " Maria"
    docs = [(1, f"Then came Juan {item} Lopez"), (2, f"Then came Juan {item.replace('Paul', 'Ann Lee')} Lopez"), (3, f"Juan {' '.join(item.split()[:16])} Lopez and others")]
    check(spark, docs, [(1, item)], {(1, 1), (2, 1), (3, 1)})
