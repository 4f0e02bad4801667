"""Counts what pairs of owners share, from lists of owners that are dealt to tasks by their first owner.

Rows (o, m) of whole numbers become lists of the owners of each member.  Every owner of a list is sent once
with the owners after it, as differences in two to four bytes each, and a task counts the pairs of its owners
by sorting numbers.  Tasks are as many as the pairs need, so that none holds more when there is more input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.session import cut

#: Rows of a chunk of lists; pairs that are dealt at a time; pairs of a task, and those that a task holds before it adds them up.
CHUNK, SLICE, TASK, HELD = 1 << 18, 1 << 21, 1 << 23, 1 << 25
#: Rows of a batch that a task gives back.
BATCH = 1 << 16


class Lists(NamedTuple):
    """Lists of owners in chunks, which are written once, how many pairs they make and the longest list."""

    chunks: DataFrame
    pairs: int
    most: int


def countable(rows: DataFrame) -> bool:
    """Whether owners o and members m are whole numbers."""
    return all(isinstance(rows.schema[c].dataType, IntegralType) for c in ("o", "m"))


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers as their width in bytes and then plane by plane, lowest bytes first."""
    width = 4 if not len(x) or -(1 << 31) <= x.min() and x.max() < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def wide(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").ravel().astype(np.int64)


def _chunk(o: np.ndarray, m: np.ndarray, alone: np.ndarray) -> pa.RecordBatch:
    first = np.ones(len(o), bool)
    first[1:] = (m[1:] != m[:-1]) | alone[1:] | alone[:-1]
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(o)))
    data = [narrow(o), narrow(m[starts]), narrow(counts), int(alone.sum()), int((counts * (counts - 1) // 2).sum()), int(counts.max(initial=0))]
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in data], names=["owners", "members", "counts", "alone", "pairs", "most"])


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole lists from rows in order of member and owner; only a list beyond ``CHUNK`` goes on in the next chunk."""
    held: list[tuple] = []
    n = 0

    def joined() -> list[np.ndarray]:
        o, m, alone = (np.concatenate(x) for x in zip(*held))
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (m[1:] != m[:-1]) | (alone[1:] != alone[:-1])
        return [o[new], m[new], alone[new]]

    for batch in batches:
        if not len(batch):
            continue
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        n += len(batch)
        if n >= CHUNK:
            rows = joined()
            at = np.flatnonzero((rows[1][1:] != rows[1][:-1]) | rows[2][1:])
            end = at[-1] + 1 if len(at) else len(rows[0]) - 1
            if len(at) or len(rows[0]) > CHUNK:
                yield _chunk(*(x[:end] for x in rows))
                rows = [x[end:] for x in rows]
            held, n = [tuple(rows)], len(rows[0])
    if held:
        yield _chunk(*joined())


def lists(rows: DataFrame) -> Lists:
    """The lists of owners of rows (o, m), which may be repeated; rows without a member are lists of one."""
    plain = rows.where("o is not null").select(F.col("o").cast("long"), F.coalesce(F.col("m").cast("long"), F.lit(0)).alias("m"), F.col("m").isNull().alias("alone"))
    ordered = plain.repartition("m").sortWithinPartitions("alone", "m", "o")
    chunks = cut(ordered.mapInArrow(_listed, "owners binary, members binary, counts binary, alone long, pairs long, most long"))
    pairs, most = chunks.agg(F.sum("pairs"), F.max("most")).first()
    return Lists(chunks, pairs or 0, most or 0)


def rows_of(found: Lists) -> DataFrame:
    """The distinct rows (o, m) of the lists, without those that have no member."""

    def run(batches):
        for batch in batches:
            for owners, members, counts, alone in zip(*(batch.column(k).to_pylist() for k in range(4))):
                counts = wide(counts)
                o, m = wide(owners), np.repeat(wide(members), counts)
                for k in range(0, len(o) - alone, BATCH):
                    end = min(k + BATCH, len(o) - alone)
                    yield pa.RecordBatch.from_arrays([pa.array(o[k:end]), pa.array(m[k:end])], names=["o", "m"])

    return found.chunks.mapInArrow(run, "o long, m long")


def _dealt(owners: np.ndarray, counts: np.ndarray, parts: int, every: bool) -> pa.RecordBatch:
    """A row a task: its owners of the lists, how many owners stand after each, and those as differences."""
    after = np.repeat(np.cumsum(counts), counts) - 1 - np.arange(len(owners))
    part = ((owners.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.argsort(part, kind="stable")
    if not every:
        order = order[after[order] > 0]
    n, a, part = after[order], owners[order], part[order]
    ends = np.cumsum(n)
    at = np.arange(n.sum()) + np.repeat(order + 1 - (ends - n), n)
    apart = owners[at] - np.repeat(a, n)
    tasks, starts = np.unique(part, return_index=True)
    data: list[list] = [[], [], []]
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(part)]):
        first, last = ends[lo] - n[lo], ends[hi - 1]
        for out, x in zip(data, (a[lo:hi], n[lo:hi], apart[first:last])):
            out.append(narrow(x))
    return pa.RecordBatch.from_arrays([pa.array(tasks.astype(np.int32)), *(pa.array(x, pa.binary()) for x in data)], names=["task", "a", "n", "apart"])


def _added(a: np.ndarray, n: np.ndarray, apart: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, apart) and how often each stands, or the sum of its times; ``n`` differences belong to each a."""
    known, code = np.unique(a, return_inverse=True)
    table = None
    if len(apart) and apart.max() >= 1 << 32:
        table, apart = np.unique(apart, return_inverse=True)
    key = np.repeat(code.astype(np.int64) << 32, n) | apart
    if times is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    k = np.diff(np.append(starts, len(key))) if times is None else np.add.reduceat(times, starts) if len(key) else times
    key = key[starts]
    apart = key & 0xFFFFFFFF
    return known[key >> 32], apart if table is None else table[apart], k


def shared(found: Lists, least: int, share: float = 0.0, sizes: bool = False) -> DataFrame:
    """(a, b, k), a < b: the pairs that share k members, at least ``least`` and at least ``share`` of a's; with ``sizes`` also (a, a, its members)."""
    spark = found.chunks.sparkSession
    parts = max(-(-found.pairs // TASK), min(spark.sparkContext.defaultParallelism, -(-found.pairs // (1 << 17))), 1)
    every = sizes or share > 0

    def deal(batches):
        for batch in batches:
            for owners, counts in zip(batch.column("owners").to_pylist(), batch.column("counts").to_pylist()):
                owners, counts = wide(owners), wide(counts)
                ends, pairs = np.append(0, np.cumsum(counts)), np.cumsum(counts * (counts - 1) // 2)
                lo = 0
                while lo < len(counts):
                    hi = max(lo + 1, int(np.searchsorted(pairs, (pairs[lo - 1] if lo else 0) + SLICE, "right")))
                    yield _dealt(owners[ends[lo] : ends[hi]], counts[lo:hi], parts, every)
                    lo = hi

    def count(batches):
        held: list[tuple] = []
        done: list[tuple] = []
        many: list[tuple] = []
        n = 0

        def add():
            nonlocal held, n
            if held:
                a, each, apart = (np.concatenate(x) for x in zip(*held))
                many.append(np.unique(a, return_counts=True))
                done.append(_added(a, each, apart))
                held, n = [], 0
            if len(done) > 1:
                a, apart, k = (np.concatenate(x) for x in zip(*done))
                done[:] = [_added(a, np.ones(len(a), np.int64), apart, k)]
                known, times = (np.concatenate(x) for x in zip(*many))
                known, code = np.unique(known, return_inverse=True)
                many[:] = [(known, np.bincount(code, times, len(known)).astype(np.int64))]

        for batch in batches:
            for data in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                held.append(tuple(map(wide, data)))
                n += len(held[-1][0]) + len(held[-1][2])
                if n >= HELD:
                    add()
        add()
        if not done:
            return
        (a, apart, k), (known, size) = done[0], many[0]
        need = np.maximum(least, np.ceil(size * share - 1e-9))[np.searchsorted(known, a)]
        a, apart, k = (x[k >= need] for x in (a, apart, k))
        out = [a, a + apart, k]
        if sizes:
            out = [np.concatenate(x) for x in zip(out, (known, known, size))]
        for lo in range(0, len(out[0]), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + BATCH]) for x in out], names=["a", "b", "k"])

    sent = found.chunks.select("owners", "counts").mapInArrow(deal, "task int, a binary, n binary, apart binary")
    return sent.repartitionById(parts, F.col("task")).mapInArrow(count, "a long, b long, k long")
