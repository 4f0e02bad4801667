"""Secret scan: fixed patterns, and a character convolutional network over every candidate.

Base findings are the matches of three patterns (assign, access, hex).  Candidates are
all runs of ``LEAST`` or more token characters, whatever they look like; below that length
runs are words so often (24,000 runs of 8 or more in a MB of text, 1,800 of 12 or more) that
the network would take the whole time that a scan may take.  Each candidate that meets no
base finding is scored, with the text around it, by a network in numpy: character vectors, two convolutions, maximum and mean
over the candidate, a logistic output.  Long candidates are scored in overlapping
windows, of which the highest counts.

The network is trained on labelled findings - base findings of a bounded sample of
documents and generated secrets against other candidates and generated look-alikes.
Scores are calibrated on examples kept aside.  The threshold is the highest that still
finds ``RECALL`` of their secrets or, where a gap parts it from all other examples, the
middle of that gap.

Edge cases: null and empty texts have no spans; places count code points; repeated
doc_ids keep one result a row; with an empty table the network learns from generated
examples alone and the result is empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import pick, tidy, tidy_call, tuned, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = 12
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
KINDS = ("assign", "access", "hex", "cnn")
CONTEXT, INSIDE = 24, 48
WIDTH = 2 * CONTEXT + INSIDE
RECALL = 0.98
PLACEHOLDER = "<secret>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings, in order."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):
        a, b = run.span()
        if b - a >= 16 and "AKIA" in run[0]:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= 16]
        if b - a >= 32:
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(out)


def candidates(text: str, taken: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Places of all runs, without closing punctuation, that meet no taken span."""
    out = []
    for run in RUN.finditer(text):
        a, b = run.start(), run.start() + len(run[0].rstrip(".=-/"))
        if b - a >= LEAST and not any(s < b and a < e for s, _, e in taken):
            out.append((a, b))
    return out


_CODE = np.full(0x250, 98, np.uint8)
_CODE[32:127] = np.arange(1, 96)
_CODE[[9, 10, 13]] = 96


def encode_all(text: str, places: list[tuple[int, int]]) -> tuple[np.ndarray, list[int]]:
    """Windows over candidates, and how many each has: character codes (0 outside the text), 128 more inside the candidate."""
    starts = [range(a, max(a + 1, b - INSIDE // 2), INSIDE // 2) for a, b in places]
    counts = list(map(len, starts))
    at = np.array([x for r in starts for x in r], np.int64)[:, None] + np.arange(-CONTEXT, INSIDE + CONTEXT)
    codes = np.zeros(len(text) + 2, np.uint8)  # the two ends stand for what is outside
    codes[1:-1] = _CODE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0x24F)]
    rows = codes[np.clip(at + 1, 0, len(text) + 1)]
    a, b = (np.repeat(np.array([p[k] for p in places], np.int64), counts)[:, None] for k in (0, 1))
    return rows + ((at >= a) & (at < b)).astype(np.uint8) * np.uint8(128), counts


def encode(text: str, a: int, b: int) -> np.ndarray:
    return encode_all(text, [(a, b)])[0]


class CharCNN:
    """Embedding, two convolutions with ReLU, pooling over the candidate, logistic output."""

    def __init__(self, seed: int = 5, dim: int = 10, channels: int = 20):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (100, dim)), "w1": rng.normal(0, (2 / (5 * (dim + 1))) ** 0.5, (5 * (dim + 1), channels)), "b1": np.zeros(channels),
            "w2": rng.normal(0, (2 / (3 * channels)) ** 0.5, (3 * channels, channels)), "b2": np.zeros(channels), "v": rng.normal(0, 0.1, 2 * channels), "c": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    @staticmethod
    def _windows(x: np.ndarray, k: int) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (k // 2, k // 2), (0, 0)))
        return np.concatenate([padded[:, i : i + x.shape[1]] for i in range(k)], axis=2)

    @staticmethod
    def _fold(g: np.ndarray, k: int, width: int) -> np.ndarray:
        """Adds the gradients of overlapping windows back to their places."""
        n, length, _ = g.shape
        out = np.zeros((n, length + k - 1, width), g.dtype)
        for i in range(k):
            out[:, i : i + length] += g[:, :, i * width : (i + 1) * width]
        return out[:, k // 2 : k // 2 + length]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        codes, inside = x & 127, (x >> 7).astype(np.float32)[:, :, None]
        a0 = self._windows(np.concatenate([p["e"][codes], inside], axis=2), 5)
        z1 = a0 @ p["w1"] + p["b1"]
        a1 = self._windows(np.maximum(z1, 0), 3)
        z2 = a1 @ p["w2"] + p["b2"]
        h = np.maximum(z2, 0) * inside
        top = h.argmax(1)
        count = np.maximum(inside.sum(1), 1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.sum(1) / count], axis=1)
        return pooled @ p["v"] + p["c"], (codes, inside, a0, z1, a1, z2, top, count, pooled)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (codes, inside, a0, z1, a1, z2, top, count, pooled) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        c = len(p["b2"])
        g = {"v": d @ pooled, "c": d.sum(keepdims=True)}
        back = d[:, None] * p["v"]
        dh = np.repeat((back[:, c:] / count)[:, None], x.shape[1], axis=1)
        rows = np.arange(len(x))[:, None]
        dh[rows, top, np.arange(c)] += back[:, :c]
        dz2 = dh * inside * (z2 > 0)
        g["w2"], g["b2"] = np.einsum("nla,nlb->ab", a1, dz2, optimize=True), dz2.sum((0, 1))
        dz1 = self._fold(dz2 @ p["w2"].T, 3, c) * (z1 > 0)
        g["w1"], g["b1"] = np.einsum("nla,nlb->ab", a0, dz1, optimize=True), dz1.sum((0, 1))
        width = p["e"].shape[1]
        de = self._fold(dz1 @ p["w1"].T, 5, width + 1)[:, :, :width]
        g["e"] = np.stack([np.bincount(codes.ravel(), de[:, :, k].ravel(), minlength=100) for k in range(width)], axis=1).astype(np.float32)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.005, seed: int = 3) -> CharCNN:
        """Adam over four fifths of the examples; the others calibrate and set the threshold."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            used = rng.permutation(used)
            for a in range(0, len(used), batch):
                step += 1
                for k, g in self.gradients(x[used[a : a + batch]], y[used[a : a + batch]]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        logit, z = self.logits(x[held]), y[held].astype(float)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))
            grad = np.array([((z - p) * logit).sum() - 0.01 * (self.scale - 1), (z - p).sum() - 0.01 * self.shift])
            w = p * (1 - p)
            hess = np.array([[(w * logit * logit).sum() + 0.01, (w * logit).sum()], [(w * logit).sum(), w.sum() + 0.01]])
            self.scale, self.shift = np.array([self.scale, self.shift]) + np.clip(np.linalg.solve(hess, grad), -1, 1)
        calibrated = self.scale * logit + self.shift
        found, false = np.sort(calibrated[z == 1]), calibrated[z == 0]
        if len(found):
            least = found[int((1 - RECALL) * len(found))]
            most = false.max(initial=-30.0)
            self.threshold = float(1 / (1 + np.exp(-np.clip((least + most) / 2 if most < least else least, -30, 30))))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """What the network gives before calibration, some windows at a time."""
        return np.concatenate([np.zeros(0), *(self.forward(x[a : a + 256])[0] for a in range(0, len(x), 256))]).astype(float)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.shift, -30, 30)))


def generated(n: int, seed: int = 11) -> tuple[list[np.ndarray], list[int]]:
    """Windows of made-up secrets and look-alikes in made-up text, with their labels."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    many = lower + upper + digits

    def draw(alphabet: str, least: int, most: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(least, most)))

    def word() -> str:
        return "".join(draw("bcdfghklmnprstvwz", 1, 2) + draw("aeiou", 1, 2) + draw("nrst", 0, 2) for _ in range(rng.integers(1, 5)))

    secrets = [
        lambda: draw("0123456789abcdef", 16, 65), lambda: draw(many, 12, 45), lambda: draw(many + "+/", 24, 60) + "==", lambda: "AKIA" + draw(upper + digits, 16, 17),
        lambda: "sk_live_" + draw(many, 20, 33), lambda: "ghp_" + draw(many, 36, 37), lambda: "eyJ" + draw(many, 20, 40) + "." + draw(many + "_-", 30, 60),
        lambda: draw(upper + digits, 14, 40), lambda: draw(many + "_-", 16, 45), lambda: draw(upper, 18, 36), lambda: draw(lower + digits, 14, 36),
    ]
    others = [
        lambda: draw(digits, 16, 20), lambda: "_".join(word() for _ in range(4)), lambda: "/".join(word() for _ in range(4)), lambda: f"mail{draw(digits, 1, 3)}.example.com",
        lambda: f"20{draw(digits, 2, 3)}-{draw(digits, 2, 3)}-{draw(digits, 2, 3)}T{draw(digits, 2, 3)}", lambda: "-".join(word() for _ in range(3)) + draw(digits, 1, 3),
        lambda: word() + word().capitalize() + word().capitalize(), lambda: "==" + "=" * int(rng.integers(14, 40)), lambda: "www." + word() + word() + "." + draw(lower, 2, 4),
        lambda: f"v{draw(digits, 1, 3)}.{draw(digits, 1, 3)}.{draw(digits, 1, 3)}-" + word() + word() + word(), lambda: (word() + word()).capitalize() + "." + (word() + word()).capitalize(),
        lambda: word() + word() + word(), lambda: (word() + word() + word()).capitalize(), lambda: (word() + word()).upper(), lambda: (word() + word()).upper() + "_" + word().upper(),
    ]
    rows, labels = [], []
    for i in range(n):
        label = int(i % 2 == 0)
        makers = secrets if label else others
        value = makers[int(rng.integers(len(makers)))]()
        while len(value) < LEAST:
            value += "_" + word() if not label else draw(many, 8, 9)
        before, after = " ".join(word() for _ in range(5)), " ".join(word() for _ in range(5))
        text = f"{before} {value} {after}"
        rows.append(encode(text, len(before) + 1, len(before) + 1 + len(value)))
        labels += [label] * len(rows[-1])
    return rows, labels


FINDINGS = pa.schema([("label", pa.int32()), ("window", pa.binary())])


@tidy_call
def train(docs: DataFrame, max_docs: int = 3000, max_each: int = 3000, n_generated: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> CharCNN:
    """Fits on the findings of at most ``max_docs`` documents (whole texts, first in the order of a hash of
    doc_id), at most ``max_each`` windows a label, and generated examples."""
    texts = pick(docs, doc_id=id_col, text=text_col)
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).distinct()

    def findings(batches):
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                text = text or ""
                taken = base_spans(text)
                secrets, others = [(max(a, text.rfind(" ", a, b) + 1), b) for a, _, b in taken], candidates(text, taken)
                rows, counts = encode_all(text, secrets + others)
                labels = np.repeat([1] * len(secrets) + [0] * len(others), counts)
                out += [{"label": int(label), "window": row.tobytes()} for label, row in zip(labels, rows)]
                if others and len(capitals := text.upper()) == len(text):  # words in capitals are rare, and no secrets
                    out += [{"label": 0, "window": row.tobytes()} for row in encode_all(capitals, others)[0]]
            yield pa.RecordBatch.from_pylist(out, FINDINGS)

    found = written(texts.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(tidy(findings), "label int, window binary").distinct(), "findings")
    first = [found.where(F.col("label") == k).orderBy(F.xxhash64("window"), "window").limit(max_each) for k in (0, 1)]
    rows = first[0].union(first[1]).orderBy("label", "window").collect()
    windows, labels = generated(n_generated)
    x = np.concatenate([*windows, np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WIDTH)])
    return CharCNN().fit(x, np.array(labels + [r["label"] for r in rows], np.float32))


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find_all(texts: list[str], net: CharCNN) -> list[list[dict]]:
    """All spans of every text, by start and then kind; base findings have score 1."""
    out, owners, rows, counts = [], [], [], []

    def decide() -> None:
        """Scores the windows gathered so far; a candidate has the highest score of its windows."""
        if owners:
            best = np.maximum.reduceat(net.scores(np.concatenate(rows)), np.cumsum([0, *counts])[:-1])
            for (i, a, b), score in zip(owners, best.tolist()):
                if score >= net.threshold:
                    out[i].append({"kind": "cnn", "start": a, "end": b, "score": score})
            for held in (owners, rows, counts):
                held.clear()

    for i, text in enumerate(texts):
        base = base_spans(text)
        out.append([{"kind": KINDS[k], "start": a, "end": b, "score": 1.0} for a, k, b in base])
        places = candidates(text, base)
        for start in range(0, len(places), 512):
            some = places[start : start + 512]
            windows, n = encode_all(text, some)
            owners += [(i, a, b) for a, b in some]
            rows.append(windows)
            counts += n
            if len(owners) >= 512:
                decide()
    decide()
    return [sorted(spans, key=lambda s: (s["start"], KINDS.index(s["kind"]))) for spans in out]


def redact(text: str, spans: list[dict]) -> str:
    """The text with every stretch that spans cover replaced by a placeholder."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], PLACEHOLDER]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, net: CharCNN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), redacted: bool = False, out: tuple[str, str] = ("spans", "redacted")) -> DataFrame:
    """doc_id, kept columns and spans of every row; with ``redacted`` also the cleaned text (null
    stays null).  ``out`` names the two new columns."""
    rows = pick(docs, doc_id=id_col, **{k: k for k in keep}, _text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            spans = find_all([t or "" for t in texts], shared.value)
            columns = [*batch.columns[:-1], pa.array(spans, ARROW_SPANS)]
            if redacted:
                columns.append(pa.array([None if t is None else redact(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], *out[: 1 + redacted]])

    return rows.mapInArrow(tidy(run), kept + f"`{out[0]}` {SPANS}" + (f", `{out[1]}` string" if redacted else ""))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"] != "cnn")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
