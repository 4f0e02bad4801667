"""Sliding-window counting, Bloom probing and reservoir sampling over streams.

Event time with a watermark bounds the state.  Batch tables go through the same plans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.sketch import bloom_probe, fm_estimate, frequency_report, reservoir, top_frequencies


def sliding(ts: str, length: str, slide: str) -> F.Column:
    return F.window(F.col(ts), length, slide)


def sliding_distinct(events: DataFrame, value: str, length: str, slide: str, ts: str = "ts", late: str = "1 hour", exact: bool = True) -> DataFrame:
    """(window_start, window_end, n): distinct values in every sliding window; empty windows have no row.

    A stream keeps each value of an open window once (``exact``), a row of state a value, and
    counts them, or keeps HyperLogLog sketches.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    window = sliding(ts, length, slide).alias("w")
    if not exact:
        found = rows.groupBy(window).agg(F.approx_count_distinct(value).alias("n"))
    elif events.isStreaming:
        found = rows.select(window, F.col(value).alias("v")).dropDuplicates(["w", "v"]).groupBy("w").agg(F.count("v").alias("n"))
    else:
        found = rows.groupBy(window).agg(F.countDistinct(value).alias("n"))
    return found.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sliding_fm(events: DataFrame, value: str, length: str, slide: str, ts: str = "ts", form: str = "square") -> DataFrame:
    """(window_start, n_distinct, estimate) by Flajolet-Martin in every sliding window of a batch."""
    rows = events.select(sliding(ts, length, slide)["start"].alias("window_start"), value)
    return fm_estimate(rows, value, "window_start", form=form)


def wall_clock() -> F.Column:
    """The clock when a query runs, as text."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def fm_batches(sink: Callable[[DataFrame, int], None], value: str, form: str = "square", stamped: bool = False) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: truth and estimate of each micro-batch to a sink; empty batches give no row.

    With ``stamped`` the clock at which the batch ran stands before them, as ``time``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        found = fm_estimate(batch, value, form=form)
        sink(found.select(wall_clock().alias("time"), "*") if stamped else found, batch_id)

    return run


def stream_bloom(names: DataFrame, bits: DataFrame, col: str = "name") -> DataFrame:
    """A stream of names with ``present``, joined to a fixed table of set bits."""
    return bloom_probe(names, bits, col)


class ReservoirSink:
    """A foreachBatch function that keeps a uniform sample of k rows over all batches.

    The sample is the rows with the least key hash, so merging the kept rows with a new
    batch's gives the sample of both; a batch that is run again changes nothing.  Each batch
    writes a folder of its own, from which a restarted query goes on.  With ``value`` it
    also writes a report a batch: how many rows came so far and the most frequent values of
    the sample, ties included.
    """

    def __init__(self, path: str, key: str, k: int = 100, seed: int | None = None, value: str | None = None, top: int = 3):
        self.path, self.key, self.k, self.seed, self.value, self.top = path, key, k, seed, value, top

    def _last(self, spark, before: int | None = None) -> int:
        """The last batch that was written whole, -1 if there is none."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return -1
        ready = [x.getPath() for x in store.listStatus(path) if x.getPath().getName().isdigit()]
        done = [int(x.getName()) for x in ready if store.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
        return max((n for n in done if before is None or n < before), default=-1)

    def _at(self, n: int) -> str:
        return f"{self.path}/{n:08d}"

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = self._last(spark, batch_id)
        rows, seen = batch.select("*", F.lit(None).cast("long").alias("_seen")), batch.count()
        if last >= 0:
            kept = spark.read.schema(rows.schema).parquet(self._at(last))
            seen += kept.agg(F.max("_seen")).first()[0] or 0
            rows = rows.unionByName(kept)
        sample = reservoir(rows.dropDuplicates([self.key]), self.key, self.k, self.seed).withColumn("_seen", F.lit(seen).cast("long"))
        sample.write.mode("overwrite").parquet(self._at(batch_id))
        if self.value is not None and seen:
            report = frequency_report(seen, [tuple(r) for r in top_frequencies(self.sample(spark, batch_id), self.value, self.top).collect()])
            spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/report={batch_id:08d}")

    def sample(self, spark, batch_id: int | None = None) -> DataFrame:
        """The sample after a batch, by default after the last."""
        return spark.read.parquet(self._at(self._last(spark) if batch_id is None else batch_id)).drop("_seen")
