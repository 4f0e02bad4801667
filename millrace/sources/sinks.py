"""Sinks and report formats."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def pair_model(pairs: DataFrame, path: str) -> None:
    """A model of pairs (a, b, sim) as JSON lines of b1, b2 and sim."""
    json_lines(pairs.select(F.col("a").cast("string").alias("b1"), F.col("b").cast("string").alias("b2"), "sim"), path)


def json_object(summary: DataFrame) -> str:
    """A one-row summary as a JSON object."""
    return json.dumps(summary.first().asDict(recursive=True), default=str, ensure_ascii=False)


def quoted(items: str = "items") -> F.Column:
    """An array as ('a', 'b'); a single item without a comma after it."""
    return F.concat(F.lit("('"), F.array_join(items, "', '"), F.lit("')"))


def itemset_lines(sets: DataFrame) -> DataFrame:
    """(size, line) of a table of itemsets: the sets of a size in order, comma-joined."""
    rows = sets.select(F.size("items").alias("size"), F.struct("items", quoted("items").alias("text")).alias("r"))
    return rows.groupBy("size").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["text"]), ",").alias("line")).orderBy("size")


def itemset_report(candidates: DataFrame, frequent: DataFrame) -> str:
    """The text report: candidates, then frequent itemsets, a blank line between sizes."""
    parts = [("Candidates:", candidates), ("Frequent Itemsets:", frequent)]
    return "\n\n".join(title + "\n" + "\n\n".join(r["line"] for r in itemset_lines(sets).toLocalIterator()) for title, sets in parts)


def community_lines(members: DataFrame) -> DataFrame:
    """(size, line) a community, by size and then members: 'a', 'b'."""
    groups = members.groupBy("community").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("m"))
    return groups.select(F.size("m").alias("size"), "m", F.concat(F.lit("'"), F.array_join("m", "', '"), F.lit("'")).alias("line")).orderBy("size", "m").select("size", "line")


def betweenness_lines(edges: DataFrame) -> DataFrame:
    """('a', 'b'), value a line, by falling value and then pair."""
    return edges.orderBy(F.desc("betweenness"), "a", "b").select(F.concat(F.lit("('"), F.col("a").cast("string"), F.lit("', '"), F.col("b").cast("string"), F.lit("'), "), F.col("betweenness").cast("string")).alias("line"))


def true_false(flags: DataFrame, place: str, flag: str) -> str:
    """T and F by place, space-joined."""
    return " ".join("T" if r[flag] else "F" for r in flags.orderBy(place).select(flag).toLocalIterator())


def append_batches(path: str, header: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch to a folder of its own.

    The folder is named by the batch, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("header", header).csv(f"{path}/batch={batch_id:08d}")

    return write
