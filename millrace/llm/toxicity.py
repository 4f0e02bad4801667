"""Toxicity by the nearest labelled examples, exact TF-IDF cosine over a block-max index.

Terms are the words of the texts, and all words of all examples are in the index.  A term
weighs (1 + ln tf) idf r: idf from its document frequency in all documents, r its
relevance in the labelled examples, the root of its chi-square less ``DOUBT`` and never
nought.  Words that no example has take no part.  Examples are a bounded sample of
labelled documents, whole texts.

Postings of rare terms are traversed whole.  Those of the ``DENSE`` most frequent terms are
kept by block of examples with their largest weight in the block, and a block is opened
only where what the rare terms give in it and its largest weights together reach the k-th
best cosine found so far: the neighbours are exactly those of a full scan.

Neighbours vote by distance, 1 / (1 - cosine + softening).  A logistic calibration, fitted
on the examples with each one's own vote left out, turns the vote, the best cosine and
"no neighbour" into a score; neighbours are returned as evidence.

Edge cases: null or empty texts, and texts without a known term, have no neighbours
and get the calibrated score of such texts; null labels are left out; equal texts count
once as examples; ties go to the smaller place in the index; with no labels or one class
only, the score is the smoothed share of ones; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import WordCache, by_group, flatten, pick, ragged_take, slices, tidy, tidy_call, tuned, within_budget, written
from millrace.llm.quality import bounded_sample, learnable

BLOCK = 32
#: How many of the most frequent terms are bounded by blocks; which ones are changes no result.
DENSE = 1024
NEIGHBOURS = 15
SOFTENING = 0.1
#: What chance alone may give a term in chi-square, and the least relevance of a term.
DOUBT, LEAST = 4.0, 0.5
#: Cosines are rounded to so many digits, so that they do not depend on what is scored together.
DIGITS = 9
#: Blocks that are opened before the first look at the bounds.
AT_ONCE = 8
#: Documents that are searched together.
TOGETHER = 128
SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("text_key", pa.binary()), ("terms", pa.binary()), ("counts", pa.binary()), ("size", pa.int64())])
_EDGES = "\"'`.,:;!?()[]{}<>|&%$#*-_/\\"


def _terms(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed word of every chunk, if it has one: lower-cased, without punctuation around it."""
    import xxhash

    words = [c.strip(_EDGES).lower() for c in chunks]
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words if w), np.uint64), np.fromiter(map(bool, words), np.int64, len(words))


def chi_square(with_term: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Per term the chi-square of its document frequency in two classes (columns)."""
    a, b = with_term[:, 1].astype(float), with_term[:, 0].astype(float)
    c, d = totals[1] - a, totals[0] - b
    below = (a + b) * (c + d) * (a + c) * (b + d)
    return np.where(below > 0, (a * d - b * c) ** 2 * totals.sum() / np.maximum(below, 1), 0)


class BlockMaxIndex:
    """Exact top-k cosine over sparse unit vectors of examples, given as (owner, term, weight)."""

    def __init__(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, n_terms: int, dense: int = DENSE):
        self.n, self.n_terms, self.n_blocks = n, n_terms, max(1, -(-n // BLOCK))
        order = np.lexsort((owner, term))
        self.owner, self.term, self.weight = owner[order].astype(np.int32), term[order].astype(np.int32), weight[order]
        self.df = np.bincount(term, minlength=n_terms)
        self.frequent = np.sort(np.argsort(-self.df, kind="stable")[:dense])
        self._opened = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_opened": None}

    def _open(self) -> tuple:
        """Column of every frequent term, weights and largest weights by block, and starts of the postings; made once a worker."""
        if self._opened is None:
            column = np.full(self.n_terms, -1, np.int32)
            column[self.frequent] = np.arange(len(self.frequent))
            held = column[self.term] >= 0
            weights = np.zeros((self.n_blocks * BLOCK, len(self.frequent)))
            weights[self.owner[held], column[self.term[held]]] = self.weight[held]
            weights = weights.reshape(self.n_blocks, BLOCK, -1)
            self._opened = column, weights, np.ascontiguousarray(weights.max(1).T), np.cumsum(self.df) - self.df
        return self._opened

    def search_all(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of n queries (owner, term, weight) the k nearest examples and their cosines, falling; ties by the
        example's place.  ``skip`` names an example a query that does not count."""
        column, weights, largest, starts = self._open()
        width = self.n_blocks * BLOCK
        at = column[term]
        rare = at < 0
        lengths = self.df[term[rare]]
        posts = ragged_take(starts[term[rare]], lengths)
        cells = np.repeat(owner[rare].astype(np.int64) * width, lengths) + self.owner[posts]
        base = np.bincount(cells, np.repeat(weight[rare], lengths) * self.weight[posts], minlength=n * width).reshape(n, self.n_blocks, BLOCK)
        asked = np.zeros((n, len(self.frequent)))
        asked[owner[~rare], at[~rare]] = weight[~rare]
        bounds = np.round(base.max(2) + asked @ largest + 2 * 10.0**-DIGITS, DIGITS)
        cosines = np.zeros((n, self.n_blocks, BLOCK))
        least = np.zeros(n)
        todo = np.zeros((n, self.n_blocks), bool)
        first = np.argpartition(-bounds, min(AT_ONCE, self.n_blocks) - 1, axis=1)[:, :AT_ONCE]
        todo[np.arange(n)[:, None], first] = True
        done = np.zeros_like(todo)
        for _ in range(2):
            for block in np.flatnonzero(todo.any(0)).tolist():
                rows = np.flatnonzero(todo[:, block])
                cosines[rows, block] = np.round(base[rows, block] + asked[rows] @ weights[block].T, DIGITS)
            if skip is not None:
                own = np.flatnonzero(skip >= 0)
                cosines.reshape(n, width)[own, skip[own]] = 0
            done |= todo
            if width > k:
                least = -np.partition(-cosines.reshape(n, width), k - 1, axis=1)[:, k - 1]
            todo = ~done & (bounds >= least[:, None]) & (bounds > 0)
        out = []
        flat = cosines.reshape(n, width)
        for q in range(n):
            ids = np.flatnonzero((flat[q] >= least[q]) & (flat[q] > 0))
            ids = ids[np.lexsort((ids, -flat[q, ids]))[:k]]
            out.append((ids, flat[q, ids]))
        return out


class Model:
    """Vocabulary, index, labels and calibration."""

    def __init__(self, doc_ids: list[int], labels: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], shares: np.ndarray, document_frequency, k: int = NEIGHBOURS):
        """shares: how many labelled rows of class 0 and 1 the sample stands for; document_frequency: a function from the
        sorted vocabulary to how many documents there are and how many have each term."""
        self.k = k
        totals = np.bincount(labels, minlength=2)
        self.prior = float((shares[1] + 1) / (shares.sum() + 2))
        self.flat = not totals.all()
        if self.flat:
            return
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        self.vocabulary, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
        owner, n_terms = np.repeat(np.arange(len(terms)), lengths), max(1, len(self.vocabulary))
        by_class = np.stack([np.bincount(term[labels[owner] == c], minlength=n_terms) for c in (0, 1)], axis=1)
        n_docs, df = document_frequency(self.vocabulary)
        relevance = np.maximum(np.sqrt(np.maximum(chi_square(by_class, totals) - DOUBT, 0)), LEAST)
        self.factor = np.log(1 + n_docs / np.maximum(df, 1)) * relevance if len(self.vocabulary) else np.zeros(1)
        flat_counts = np.concatenate([np.zeros(0, np.uint32), *counts])
        weight = self._unit(owner, term, flat_counts, len(labels))
        # examples of one label and strongest term stand together, which makes the bounds of blocks tight
        place = np.lexsort((weight, owner))
        strongest = np.full(len(labels), -1)
        strongest[owner[place]] = term[place]
        order = np.lexsort((strongest, labels))
        order = order[strongest[order] >= 0]
        number = np.full(len(labels), -1)
        number[order] = np.arange(len(order))
        self.labels, self.doc_ids = labels[order], np.array(doc_ids, np.int64)[order]
        self.index = BlockMaxIndex(number[owner], term, weight, len(order), n_terms)
        self._calibrate(labels, number, owner, term, flat_counts, by_class.sum(1), shares / np.maximum(totals, 1))

    def _unit(self, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
        """Unit weights of the terms of n texts."""
        weight = (1 + np.log(counts)) * self.factor[term]
        norm = np.sqrt(np.bincount(owner, weight * weight, minlength=n))
        return weight / norm[owner]

    def _vote(self, ids: np.ndarray, cosines: np.ndarray) -> float:
        weight = 1 / (1 - np.minimum(cosines, 1) + SOFTENING)
        return float((weight * self.labels[ids]).sum() / weight.sum())

    def neighbours(self, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """The nearest examples of n texts, given as (owner, term, count) in the order of owners."""
        weight, out = self._unit(owner, term, counts, n), []
        cuts = np.searchsorted(owner, np.arange(0, n + TOGETHER, TOGETHER))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            first = i * TOGETHER
            m = min(TOGETHER, n - first)
            if m > 0:
                out += self.index.search_all(owner[a:b] - first, term[a:b], weight[a:b], m, self.k, None if skip is None else skip[first : first + m])
        return out

    def _calibrate(self, labels: np.ndarray, number: np.ndarray, owner: np.ndarray, term: np.ndarray, counts: np.ndarray, df: np.ndarray, inverse: np.ndarray) -> None:
        """Weighted logistic regression of the label on vote and best cosine, own example and its own words left out."""
        others = df[term] > 1
        found = self.neighbours(owner[others], term[others], counts[others], len(labels), number)
        weight, inputs, at = inverse[labels], [], []
        for i, (ids, cosines) in enumerate(found):
            if len(ids):
                inputs.append((1, self._vote(ids, cosines) - 0.5, cosines[0]))
                at.append(i)
        none = np.setdiff1d(np.arange(len(labels)), at)
        self.no_neighbour = float(((labels[none] * weight[none]).sum() + self.prior) / (weight[none].sum() + 1))
        x, y, w = np.array(inputs).reshape(-1, 3), labels[at].astype(float), weight[at]
        w = w / max(w.sum(), 1e-9) * max(len(w), 1)
        beta = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            grad = x.T @ (w * (y - p)) - 0.05 * beta
            hess = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(3)
            beta = beta + np.clip(np.linalg.solve(hess, grad), -5, 5)
        self.beta = beta

    def word_numbers(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every chunk's word in the vocabulary, if it is in it."""
        return known_numbers(self.vocabulary, chunks)

    def score_all(self, texts: list[str], cache: WordCache) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, and the nearest examples with their cosines, of every text."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if self.flat:
            return [(self.prior, *none)] * len(texts)
        out = []
        for ids, cosines in self.neighbours(*text_terms(texts, cache, len(self.vocabulary)), len(texts)):
            if len(ids):
                z = np.clip(self.beta @ (1, self._vote(ids, cosines) - 0.5, cosines[0]), -30, 30)
                out.append((float(1 / (1 + np.exp(-z))), ids, cosines))
            else:
                out.append((self.no_neighbour, *none))
        return out


def known_numbers(vocabulary: np.ndarray, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the chunks' words in a sorted vocabulary, and how many (0 or 1) each has."""
    found, lengths = _terms(chunks)
    at = np.searchsorted(vocabulary, found)
    known = np.zeros(len(found), bool)
    inside = at < len(vocabulary)
    known[inside] = vocabulary[at[inside]] == found[inside]
    lengths[lengths > 0] = known
    return at[known].astype(np.uint32), lengths


def text_terms(texts: list[str], cache: WordCache, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, count) of the known terms of texts, in the order of owners and terms."""
    words, counts = flatten(t.split() for t in texts)
    flat, lengths = cache.take(cache.codes(words))
    owner = np.repeat(np.arange(len(texts)), by_group(lengths, counts))
    cells, n = np.unique(owner * max(1, n_terms) + flat, return_counts=True)
    return cells // max(1, n_terms), cells % max(1, n_terms), n


def document_frequency(texts: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each term of the vocabulary.

    Each task counts by term and sends one row a term it met; sums are partial before they
    are shuffled, and at most a row a term of the bounded vocabulary comes to the driver.
    """
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        cache = WordCache(lambda chunks: known_numbers(vocabulary, chunks), "uint32")
        total, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            some = [t or "" for t in batch.column(0).to_pylist()]
            n += len(some)
            for a, b in slices(some):
                total += np.bincount(text_terms(some[a:b], cache, len(vocabulary))[1], minlength=len(vocabulary))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["term", "n"])

    rows = texts.select("text").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary) + 1, np.int64)  # the last place is that of -1
    out[rows.column("term").to_numpy()] = rows.column("n").to_numpy()
    shared.destroy()
    return int(out[-1]), out[:-1]


@tidy_call
def train(docs: DataFrame, labels: DataFrame, max_ones: int = 2000, max_zeros: int = 3000, max_terms: int = 4_000_000, k: int = NEIGHBOURS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on at most max_ones + max_zeros labelled rows (doc_id, label), in the order of a hash of doc_id,
    whose distinct terms are at most max_terms in all; whole texts, however many examples that makes."""
    totals = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    sample = bounded_sample(labels.where("label = 1"), max_ones).union(bounded_sample(labels.where("label = 0"), max_zeros))
    texts = pick(docs, doc_id=id_col, text=text_col)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def features(batches):
        import xxhash

        cache = WordCache(_terms, "uint64")
        for batch in batches:
            out = []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                flat, _ = cache.take(cache.codes((text or "").split()))
                terms, counts = np.unique(flat, return_counts=True)
                out.append({"doc_id": doc_id, "label": label, "text_key": xxhash.xxh3_128_digest((text or "").encode()), "terms": terms.astype("<u8").tobytes(), "counts": counts.astype("<u4").tobytes(), "size": len(terms)})
            yield pa.RecordBatch.from_pylist(out, SAMPLE)

    made = written(rows.mapInArrow(tidy(features), "doc_id long, label int, text_key binary, terms binary, counts binary, size long"), "toxicity-examples")
    found = within_budget(made, "size", max_terms, "text_key").sort_by([("label", "descending"), ("doc_id", "ascending"), ("text_key", "ascending")])
    once: dict[bytes, int] = {}
    for i, key in enumerate(found.column("text_key").to_pylist()):
        once.setdefault(key, i)
    found = found.take(pa.array(sorted(once.values()), pa.int64()))
    terms = [np.frombuffer(x.as_py(), "<u8") for x in found.column("terms")]
    counts = [np.frombuffer(x.as_py(), "<u4") for x in found.column("counts")]
    shares = np.array([totals.get(0, 0), totals.get(1, 0)], float)
    return Model(found.column("doc_id").to_pylist(), np.array(found.column("label").to_pylist(), np.int64), terms, counts, shares, lambda v: document_frequency(texts, v), k)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", n_evidence: int = 3) -> DataFrame:
    """doc_id, score and the nearest examples (doc_id, label, cosine) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = pick(docs, doc_id=id_col, text=text_col)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        model = shared.value
        cache = None if model.flat else WordCache(model.word_numbers, "uint32")
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            scores, seen = [], []
            for a, b in slices(texts):
                for value, ids, cosines in model.score_all(texts[a:b], cache):
                    scores.append(value)
                    seen.append([{"doc_id": int(model.doc_ids[i]), "label": int(model.labels[i]), "cosine": float(c)} for i, c in zip(ids[:n_evidence], cosines[:n_evidence])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(seen, evidence)], ["doc_id", "score", "evidence"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, learnable(labels, "toxic", fold=0, folds=5))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.concat_ws(",", F.transform("evidence", lambda e: e["doc_id"].cast("string"))).alias("nearest"),
    )
