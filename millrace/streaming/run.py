"""Starting, draining and stopping streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def micro_batches(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds", mode: str = "append") -> StreamingQuery:
    """Starts a query that hands each micro-batch to a function.

    With a checkpoint in a shared folder a restarted query goes on where it stopped; a
    batch may then run again, under the same number.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(function).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drain(stream: DataFrame, function: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs what has arrived so far through a function, in micro-batches, and stops."""
    stream.writeStream.outputMode(mode).foreachBatch(function).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stop(query: StreamingQuery, wait_s: int = 30) -> None:
    """Stops a query and waits for its batch to end."""
    query.stop()
    query.awaitTermination(wait_s)
