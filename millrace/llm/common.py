"""What the operators of this subpackage share: the shared folder, written tables,
column picking and a bounded cache of per-word results."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.session import shared_dir

#: Characters of text that a worker handles at once; longer single texts are handled alone.
SLICE_CHARS = 400_000


def tuned(spark: SparkSession, rows: int = 2000) -> SparkSession:
    """The session, with Arrow batches of whole texts kept small: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)
    return spark


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


#: Paths that this process made and has not swept.
_MADE: list[str] = []


def n_made() -> int:
    """How many paths there are, for ``sweep``."""
    return len(_MADE)


def sweep(since: int) -> None:
    """Removes what this process made after there were ``since`` paths, but for the last one; DataFrames over it end there."""
    for path in _MADE[since:-1]:
        store, local = filesystem(path)
        if store.get_file_info(local).type != pafs.FileType.NotFound:
            store.delete_dir(local)
    del _MADE[since:-1]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of text that a bucket or task should hold, and how many tasks a stage is dealt to at most: beyond, tasks
#: hold several buckets, one after the other.
SHARE = 16_000_000
MOST_TASKS = 20_000


def text_bytes(df: DataFrame, col: str = "text") -> int:
    """About how many bytes of text a table holds: twice its files' size, as Parquet packs text, or else a count of them.

    It only sizes buckets and tasks; results never depend on it.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    if sum(sizes) < 1 << 60:
        return 2 * sum(sizes)
    return df.agg(F.sum(F.octet_length(col))).first()[0] or 0


def n_buckets(size: int) -> int:
    """Hash buckets for so many bytes of text: they hold about the same whatever the size."""
    return max(1, -(-size // SHARE))


def n_tasks(spark: SparkSession, size: int) -> int:
    """Tasks for so many bytes of text, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, min(n_buckets(size), MOST_TASKS))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _release() -> None:
    """Gives memory that a finished task no longer needs back to the machine; workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def tidy(run: Callable) -> Callable:
    """A function over batches that leaves no memory behind in its worker."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """The same for a function over the table of a group."""

    def tidied(table):
        try:
            return run(table)
        finally:
            _release()

    return tidied


def tidy_call(run: Callable) -> Callable:
    """The same for a function that works in the driver."""

    @wraps(run)
    def tidied(*args, **options):
        try:
            return run(*args, **options)
        finally:
            _release()

    return tidied


def binary_views(column: pa.ChunkedArray, dtype: str) -> list[np.ndarray]:
    """Every value of a column of bytes without nulls as an array over the column's own memory."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        kind = np.int64 if pa.types.is_large_binary(chunk.type) else np.int32
        ends = np.frombuffer(offsets, kind)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else [0]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        out += [data[a:b].view(dtype) for a, b in zip(ends, ends[1:])]
    return out


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns cannot clash."""
    return df.select(*[F.col("`" + old.replace("`", "``") + "`").alias(new) for new, old in columns.items()])


#: Bits of the tables that drop rows before a shuffle; 2 MB each.
BITS = 1 << 24


def bit_table(df: DataFrame, col: str) -> np.ndarray:
    """A fixed-size table with the bits (value mod BITS) of a column of longs set.

    Bits are put together into bytes by the cluster: at most BITS / 8 bytes reach the
    driver, whatever the rows.  A full table drops nothing, which costs time only.
    """
    bit = F.pmod(F.col(col), F.lit(BITS))
    rows = df.where(F.col(col).isNotNull()).select(bit.alias("bit")).distinct()
    rows = rows.groupBy(F.shiftright("bit", 3).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).cast("int").alias("bits")).toArrow()
    table = np.zeros(BITS // 8, np.uint8)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return table


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values (longs, or their bits as unsigned) have their bit set; false only for values not in the column."""
    bit = values % values.dtype.type(BITS)
    return (table[(bit >> bit.dtype.type(3)).astype(np.int64)] >> (bit & bit.dtype.type(7)).astype(np.uint8)) & 1 == 1


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about ``limit`` characters each; no text is cut."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every (start, length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def by_group(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values; empty runs give 0."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


class _Numbers(dict):
    """Numbers strings in the order in which they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class WordCache:
    """Arrays computed once per distinct string and looked up for whole lists of strings.

    ``make`` maps a list of strings to a list of arrays, or to all arrays joined and their
    lengths.  At more than ``limit`` strings the cache starts anew, so memory is bounded;
    results do not depend on what it holds.
    """

    def __init__(self, make: Callable[[list[str]], list[np.ndarray] | tuple[np.ndarray, np.ndarray]], dtype: str, limit: int = 300_000):
        self.make, self.dtype, self.limit = make, np.dtype(dtype), limit
        self.clear()

    def clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.zeros(1024, self.dtype)
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.used = 0

    def _room(self, name: str, need: int) -> np.ndarray:
        held = getattr(self, name)
        if need > len(held):
            grown = np.zeros(max(need, 2 * len(held)), held.dtype)
            grown[: len(held)] = held
            setattr(self, name, grown)
        return getattr(self, name)

    def _add(self, n: int) -> None:
        """Computes the arrays of the strings numbered from n on."""
        words = list(islice(reversed(self.index), len(self.index) - n))[::-1]
        made = self.make(words)
        if isinstance(made, tuple):
            joined, lengths = made
        else:
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            joined = np.concatenate(made) if made else np.zeros(0, self.dtype)
        total = int(lengths.sum())
        self._room("flat", self.used + total)[self.used : self.used + total] = joined
        self._room("starts", n + len(words))[n : n + len(words)] = self.used + np.cumsum(lengths) - lengths
        self._room("lengths", n + len(words))[n : n + len(words)] = lengths
        self.used += total

    def codes(self, words: list[str]) -> np.ndarray:
        """A code per word, valid until the next call."""
        if len(self.index) > self.limit:
            self.clear()
        n = len(self.index)
        codes = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if len(self.index) > n:
            try:
                self._add(n)
            except BaseException:
                self.clear()  # numbers without arrays must not stay
                raise
        return codes

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of the codes one after the other, and their lengths."""
        lengths = self.lengths[codes]
        return self.flat[ragged_take(self.starts[codes], lengths)], lengths


def within_budget(rows: DataFrame, size: str, budget: int, *ties: str) -> pa.Table:
    """The rows of a written sample (at most some thousands) whose sizes fit a budget, in the order of a hash of doc_id.

    Only sizes come to the driver at first; then the rows up to where their sum passes the
    budget, and the first row always.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id"), *map(F.col, ties)]
    sums = rows.select("doc_id", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).alias("sum"), *ties)
    over = sums.where(F.col("sum") > budget).orderBy("sum").limit(1).collect()
    if not over:
        return rows.toArrow()
    return rows.orderBy(*order).limit(max(1, sums.where(F.col("sum") <= budget).count())).toArrow()


def flatten(lists: Iterable[list[str]]) -> tuple[list[str], np.ndarray]:
    """All strings in one list, and how many each list had."""
    lists = list(lists)
    return [x for words in lists for x in words], np.fromiter(map(len, lists), np.int64, len(lists))
