"""Logical relations over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, business_id, stars, date, order_id): a line item is a customer's review of a part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("business_id"), (F.col("l_quantity").cast("int") % 5 + 1).cast("double").alias("stars"),
        F.col("o_orderdate").alias("date"), F.col("l_orderkey").alias("order_id"),
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(business_id, categories): a ', '-separated list for large parts, null for others."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("business_id"), F.when(F.col("p_size") > 25, F.concat_ws(", ", "p_type", "p_brand")).alias("categories"))


def ratings(spark: SparkSession, sf_dir: str, test: bool | None = None) -> DataFrame:
    """(user, item, stars), one row a pair with its mean; orders divisible by ten are the test part."""
    rows = reviews(spark, sf_dir)
    if test is not None:
        rows = rows.where((F.col("order_id") % 10 == 0) if test else (F.col("order_id") % 10 != 0))
    return rows.groupBy(F.col("user_id").alias("user"), F.col("business_id").alias("item")).agg(F.avg("stars").alias("stars"))


def baskets(spark: SparkSession, sf_dir: str, swap: bool = False) -> DataFrame:
    """(basket, item): orders with part brands, or brands with orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").cast("string").alias("basket"), F.col("p_brand").alias("item")).distinct()
    return rows.select(F.col("item").alias("basket"), F.col("basket").alias("item")) if swap else rows


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item), a row a review, for operators that make their rows distinct themselves."""
    return reviews(spark, sf_dir).select(F.col("user_id").alias("user"), F.col("business_id").alias("item"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, business, text): documents as reviews of their source."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("user"), F.col("source").alias("business"), "text", "doc_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp, which watermarks need."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
