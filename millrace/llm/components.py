"""Connected components of a table of links, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

ROUNDS = 60


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links, component being its smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each a
    minimum per node by partial aggregation and a join, until nothing changes.  Every
    round is written to the shared folder, so lineage stays short and survives lost
    executors.  No round holds more than the links; a hub's links are never gathered.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "links")
    mark = _mark(edges)
    if not mark[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(edges, "links")
        now = _mark(edges)
        if now == mark:
            nodes = edges.groupBy("u").agg(F.min("v").alias("component"))
            roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return nodes.select(F.col("u").alias("node"), "component").union(roots)
        mark = now
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    """A small summary that changes as long as the stars change."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
