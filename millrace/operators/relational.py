"""Counts, averages, top-k and partition statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import space_tokens, split_list, strip_marks


def summary(reviews: DataFrame, year: int) -> DataFrame:
    """One row: all reviews, those of a year, distinct users and businesses."""
    return reviews.agg(
        F.count("*").alias("n_reviews"), F.count(F.when(F.year("date") == year, 1)).alias("n_reviews_year"),
        F.countDistinct("user_id").alias("n_users"), F.countDistinct("business_id").alias("n_businesses"),
    )


def count_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys; ties go to the smaller key.  No full sort: a top-k per partition, then one."""
    return count_by(df, key).orderBy(F.desc("n"), key).limit(k)


def top_words(texts: DataFrame, stopwords: list[str], k: int, text_col: str = "text") -> DataFrame:
    """The k most frequent words; marks are stripped from words but not from stop words."""
    words = texts.select(F.explode(space_tokens(F.col(text_col))).alias("w")).select(strip_marks(F.col("w")).alias("word"))
    return top_k(words.where(~F.col("word").isin([*stopwords, ""])), "word", k)


def category_average(reviews: DataFrame, businesses: DataFrame, k: int, how: str = "left") -> DataFrame:
    """Mean stars a category, highest first, ties by category with null first.

    With ``how="left"`` reviews of unknown or uncategorised businesses form a null category.
    """
    categories = businesses.where("categories is not null").select("business_id", F.explode(split_list(F.col("categories"))).alias("category"))
    means = reviews.select("business_id", "stars").join(categories, "business_id", how).groupBy("category").agg(F.avg("stars").alias("mean_stars"))
    return means.orderBy(F.desc("mean_stars"), F.asc_nulls_first("category")).limit(k).select("category", F.round("mean_stars", 6).alias("mean_stars"))


def category_average_early(reviews: DataFrame, businesses: DataFrame, k: int) -> DataFrame:
    """The inner form with sums per business taken before the join expands them."""
    sums = reviews.groupBy("business_id").agg(F.sum("stars").alias("s"), F.count("stars").alias("c"))
    categories = businesses.where("categories is not null").select("business_id", F.explode(split_list(F.col("categories"))).alias("category"))
    means = sums.join(categories, "business_id").groupBy("category").agg((F.sum("s") / F.sum("c")).alias("mean_stars"))
    return means.orderBy(F.desc("mean_stars"), "category").limit(k).select("category", F.round("mean_stars", 6).alias("mean_stars"))


def count_over(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with more than n rows."""
    return count_by(df, key).where(F.col("n") > n)


def partition_stats(df: DataFrame, key: str, n: int, partitioner: Column | None = None) -> DataFrame:
    """(partition, n) after hash partitioning by a key, or by a partitioner that gives 0 to n - 1; empty partitions count 0."""
    dealt = df.repartition(n, key) if partitioner is None else df.repartitionById(n, partitioner.cast("int"))
    dealt = dealt.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(dealt, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))
