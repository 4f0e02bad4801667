"""Benchmark decontamination by template canonicalisation.

Texts become sequences of template tokens: numbers, units after numbers and names (runs of
capitalised words, a run being one token however long) are typed placeholders, everything
else is a lower-cased word; punctuation and layout fall away.  Since text in capitals shows
no names, each text also stands with its names as plain words.  These two readings are
dealt with apart, each with places of its own.

Windows of template tokens are hash-joined between documents and benchmark items.  A
window with fewer than ``LITERALS`` plain words, or hardly more of them than names, is too
general for a template and stands as it is, numbers and names included.  Joined windows of
one reading and alignment (document place minus item place) are put together, and their
slots checked.  A name of the item must always meet the same name in the document, and no
other name of the item may meet that one; a unit must always meet the same unit.  Numbers
are parameters, and two of them may be equal by chance in the item or in the document: a
number of the item may meet two numbers, on average, and any number may be met twice.  So
a copy is found whatever its numbers, units and names have become, if they were replaced
consistently.

A fixed-size bit table of the benchmark's window hashes is broadcast and drops windows
that cannot join before anything is shuffled; it never drops one that can.

A document holds an item when windows of one alignment cover at least ``MATCH`` tokens, or
the whole item where it is shorter, with consistent slots.  Template windows alone suffice
where they cover all tokens of the item that its template windows can cover.  Where the
reading with names covers as much of the same stretch and its slots are not consistent,
the reading with plain words counts only if it covers the whole item.  Names at the two ends
of an alignment may go on outside of it, so they are not compared.

Edge cases: null and empty texts or items have no tokens and never match; items of
fewer than ``WINDOW`` tokens are one window of their own length; items without any template
window match only with the same numbers, units and names; items that occur twice match
under all their ids; every text under a repeated doc_id is judged alone, and the id is one
row an item; documents and items with a null id cannot be named and are not in the result
(whoever filters rows can name them by a digest of their text, since a text alone decides);
empty tables give an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WordCache, bit_table, flatten, in_table, pick, slices, tidy, tuned, written
from millrace.llm.subwords import BASE, mix, rolling

WINDOW = 8
LITERALS = 4
MATCH = 13

#: Units of measure that count as such after a number (fixed values).
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hrs ms us ns hz khz mhz ghz b kb mb gb tb w kw mw v a k c f pa kpa bar j kj cal kcal"
    " percent pct usd eur gbp dollars euros pounds cents meters metres kilometers kilometres miles feet inches grams kilograms liters litres"
    " seconds minutes hours days weeks months years degrees".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
#: Kinds of a token, in the low bits of its cached value, with what it says of its neighbours.
WORD, NUMBER, UNIT, NAME = 0, 1, 2, 3
CAPITAL, ENDS = np.uint64(4), np.uint64(8)
FLAGS = np.uint64(15)
PLACEHOLDERS = np.array([0, 11, 23, 37], np.uint64) * BASE


def _chunk_tokens(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values of the tokens of white-space-free chunks: hash with kind and flags in its low bits.

    ``ENDS`` marks a token after which punctuation ends a run of capitalised words.
    """
    import xxhash

    out, lengths = [], []
    for chunk in chunks:
        found = list(_TOKEN.finditer(chunk))
        for i, m in enumerate(found):
            token = m[0]
            low = token.lower()
            value = xxhash.xxh3_64_intdigest(low.encode()) & ~15
            if token[0].isdigit():
                value |= NUMBER
            elif low in UNITS:
                value |= UNIT
            if token[0].isupper() and not token.isupper():
                value |= int(CAPITAL)
            after = chunk[m.end() : found[i + 1].start() if i + 1 < len(found) else len(chunk)]
            if any(c not in "'’-" for c in after):
                value |= int(ENDS)
            out.append(value)
        lengths.append(len(found))
    return np.array(out, np.uint64), np.array(lengths, np.int64)


def token_cache() -> WordCache:
    return WordCache(_chunk_tokens, "uint64")


@dataclass
class Reading:
    """Template tokens of texts: literal hashes, kinds of slot, raw places in their text, and tokens a text."""

    names: bool
    literal: np.ndarray
    slot: np.ndarray
    raw: np.ndarray
    per_text: np.ndarray


def readings(texts: list[str], cache: WordCache) -> tuple[Reading, Reading]:
    """The texts with names as plain words, and with each run of capitalised words as one name."""
    words, counts = flatten(t.split() for t in texts)
    tokens, lengths = cache.take(cache.codes(words))
    ends = np.concatenate([[0], np.cumsum(lengths)])
    per_text = np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])
    literal, n = tokens & ~FLAGS, len(tokens)
    owner = np.repeat(np.arange(len(per_text)), per_text)
    raw = np.arange(n) - (np.cumsum(per_text) - per_text)[owner]
    before = np.concatenate([np.zeros(1, np.uint64), tokens[:-1]])[:n]
    kind = tokens & np.uint64(3)
    number = kind == NUMBER
    unit = (kind == UNIT) & (raw > 0) & ((before & np.uint64(3)) == NUMBER)
    slot = number * NUMBER + unit * UNIT
    plain = Reading(False, literal, slot, raw, per_text)
    name = ((tokens & CAPITAL) > 0) & ~unit
    goes_on = np.zeros(n, bool)
    goes_on[1:] = name[1:] & name[:-1]
    goes_on &= (raw > 0) & ((before & ENDS) == 0)
    starts = np.flatnonzero(~goes_on)
    # a run's value depends on its words and their order
    nth = np.arange(n) - np.maximum.accumulate(np.where(goes_on, 0, np.arange(n)))
    values = np.add.reduceat(mix(literal + nth.astype(np.uint64) * BASE), starts) if n else literal
    values = np.where(name[starts], values & ~FLAGS, literal[starts])
    return plain, Reading(True, values, np.where(name[starts], NAME, slot[starts]), raw[starts], np.bincount(owner[starts], minlength=len(per_text)))


def windows(r: Reading, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first token and "stands as it is" of every window of ``size`` tokens inside a text."""
    n = len(r.literal) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    template = np.where(r.slot > 0, PLACEHOLDERS[r.slot], r.literal)
    filled, named = np.concatenate([[0], np.cumsum(r.slot > 0)]), np.concatenate([[0], np.cumsum(r.slot == NAME)])
    plain, names = size - (filled[size:] - filled[:-size]), named[size:] - named[:-size]
    exact = (plain < min(LITERALS, size)) | ((names > 0) & (plain < names + 2))
    joined = np.where(exact, rolling(r.literal, size), rolling(template, size))
    owner = np.repeat(np.arange(len(r.per_text)), r.per_text)
    keep = np.flatnonzero(owner[:n] == owner[size - 1 :])
    salt = (4 * size + 2 * r.names + exact[keep]).astype(np.uint64)
    return mix(joined[keep] ^ salt), keep, exact[keep]


def _slots(r: Reading, first: int, size: int) -> list[int]:
    """The slot values of a window, their kind in the low bits; 0 stands for no slot."""
    slot = r.slot[first : first + size]
    return np.where(slot > 0, r.literal[first : first + size] | slot.astype(np.uint64), np.uint64(0)).view(np.int64).tolist()


ITEM_WINDOWS = pa.schema([
    ("hash", pa.int64()), ("item", pa.int64()), ("names", pa.bool_()), ("item_place", pa.int64()), ("exact", pa.bool_()), ("item_slots", pa.list_(pa.int64())),
    ("n_item", pa.int64()), ("n_template_item", pa.int64()),
])
WINDOWS = pa.schema([
    ("hash", pa.int64()), ("doc_id", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("slots", pa.list_(pa.int64())),
])


def item_windows(items: DataFrame) -> DataFrame:
    """All windows of items (item, text); short items are one window of their own size."""

    def run(batches):
        cache = token_cache()
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for r in readings([text or ""], cache):
                    n = len(r.literal)
                    size = min(n, WINDOW)
                    hashes, first, exact = windows(r, size) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool))
                    reached = np.zeros(n, bool)
                    for a in first[~exact].tolist():
                        reached[a : a + size] = True
                    for h, a, x in zip(hashes.view(np.int64).tolist(), first.tolist(), exact.tolist()):
                        out.append({"hash": h, "item": key, "names": r.names, "item_place": a, "exact": x, "item_slots": _slots(r, a, size), "n_item": n, "n_template_item": int(reached.sum())})
            yield pa.RecordBatch.from_pylist(out, ITEM_WINDOWS)

    kind = "hash long, item long, names boolean, item_place long, exact boolean, item_slots array<long>, n_item long, n_template_item long"
    return written(items.mapInArrow(tidy(run), kind), "item-windows")


def document_windows(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The windows of documents (doc_id, doc, text) whose hash is in the bit table of the items' windows."""
    sizes = wanted.select(F.size("item_slots").alias("n")).distinct().toArrow().column("n").to_pylist()  # at most WINDOW values
    shared = texts.sparkSession.sparkContext.broadcast((bit_table(wanted, "hash"), sorted(sizes)))

    def run(batches):
        table, sizes = shared.value
        cache = token_cache()
        for batch in batches:
            ids, docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
            for a, b in slices(texts):
                out = []
                for r in readings(texts[a:b], cache):
                    starts = np.cumsum(r.per_text) - r.per_text
                    owner = np.repeat(np.arange(a, b), r.per_text)
                    for size in sizes:
                        hashes, first, _ = windows(r, size)
                        met = np.flatnonzero(in_table(table, hashes))
                        for h, at in zip(hashes[met].view(np.int64).tolist(), first[met].tolist()):
                            o = int(owner[at])
                            out.append({"hash": h, "doc_id": ids[o], "doc": docs[o], "place": at - int(starts[o - a]), "first": int(r.raw[at]), "last": int(r.raw[at + size - 1]), "slots": _slots(r, at, size)})
                yield pa.RecordBatch.from_pylist(out, WINDOWS)

    return texts.mapInArrow(tidy(run), "hash long, doc_id long, doc long, place long, first long, last long, slots array<long>")


def alignments(met: DataFrame, match: int) -> DataFrame:
    """Per document, item, reading and shift: what its windows cover, and whether that is enough and consistent."""
    template = F.when(~F.col("exact"), F.col("item_place"))
    pairs = F.expr("filter(transform(arrays_zip(item_slots, slots), (x, i) -> struct(item_place + i as p, x.item_slots as item_slots, x.slots as slots)), x -> x.slots <> 0 or x.item_slots <> 0)")
    met = met.select("doc_id", "doc", "item", "names", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "exact", F.size("slots").alias("size"), "first", "last", "n_item", "n_template_item", pairs.alias("pairs"))
    runs = met.groupBy("doc_id", "doc", "item", "names", "shift").agg(
        F.collect_set("item_place").alias("places"), F.collect_set(template).alias("templates"), F.max("size").alias("size"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.max("n_item").alias("n_item"), F.max("n_template_item").alias("n_template_item"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("exact"), F.col("pairs"))))).alias("template_pairs"),
    )
    covered = lambda places: F.expr(f"size(array_distinct(flatten(transform({places}, p -> sequence(p, p + size - 1)))))")
    runs = runs.withColumn("n", covered("places")).withColumn("n_template", covered("templates"))
    for pairs, places in (("pairs", "places"), ("template_pairs", "templates")):
        inside = f"(x.item_slots & 3) <> {NAME} or (x.p > array_min({places}) and x.p < array_max({places}) + size - 1)"
        runs = runs.withColumn(pairs, F.expr(f"array_distinct(transform(filter({pairs}, x -> {inside}), x -> struct(x.item_slots as item_slots, x.slots as slots)))"))
    of = lambda p, kind: f"filter({p}, x -> (x.item_slots & 3) = {kind})"
    values = lambda p, side: f"size(array_distinct(transform({p}, x -> x.{side})))"
    # pairs are distinct, so each item value meets one value where there are as many values as pairs
    consistent = lambda p: F.expr(
        f"size({of(p, NAME)}) = {values(of(p, NAME), 'item_slots')} and size({of(p, NAME)}) = {values(of(p, NAME), 'slots')}"
        f" and size({of(p, UNIT)}) = {values(of(p, UNIT), 'item_slots')} and size({of(p, NUMBER)}) <= 2 * {values(of(p, NUMBER), 'item_slots')}"
    )
    same = lambda p: F.expr(f"forall({p}, x -> x.item_slots = x.slots)")
    enough = lambda n, n_item: F.col(n) >= F.least(F.lit(match), n_item)
    templates_do = enough("n_template", "n_template_item") & (F.col("n_template") > 0)
    # windows that stand as they are never undo what the template windows of an alignment show
    whole = consistent("pairs") & (enough("n", "n_item") | templates_do)
    alone = consistent("template_pairs") & templates_do
    return runs.where(enough("n", "n_item") | templates_do).select(
        "doc_id", "doc", "item", "names", "first", "last", F.when(whole, F.col("n")).when(alone, F.col("n_template")).otherwise(F.col("n")).alias("n_tokens"),
        F.when(whole, same("pairs")).otherwise(same("template_pairs")).alias("same"), (whole | alone).alias("ok"),
        (F.col("n") >= F.col("n_item")).alias("all"),
    )


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", match: int = MATCH) -> DataFrame:
    """(doc_id, item_id, n_tokens, verbatim) of every document that holds a benchmark item.

    n_tokens is what the best alignment covers; verbatim says that all its slot values are the item's.
    """
    texts = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("doc"), "text").where("doc_id is not null")
    known = pick(items, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item"), "text").where("item_id is not null")
    wanted = item_windows(known.dropDuplicates(["item"]).select("item", "text"))
    met = document_windows(texts, wanted).join(wanted, "hash").where(F.size("slots") == F.size("item_slots"))
    runs = alignments(met, match)
    runs = written(runs, "alignments")
    bad = runs.where("names and not ok").select("doc_id", "doc", "item", "first", "last", "n_tokens").alias("b")
    words = runs.where("ok and not names and not all").alias("w")
    over = F.expr("b.doc_id = w.doc_id and b.doc = w.doc and b.item = w.item and b.first <= w.last and w.first <= b.last and b.n_tokens >= w.n_tokens")
    found = runs.where("ok and (names or all)").unionByName(words.join(bad, over, "left_anti")).join(known.select("item_id", "item"), "item")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_tokens").cast("long").alias("n_tokens"), F.max("same").alias("verbatim"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
