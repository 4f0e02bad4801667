"""TF-IDF profiles, content scores and collaborative filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_number, space_tokens, strip_punctuation
from millrace.session import cut


def word_counts(texts: DataFrame, stopwords: list[str]) -> DataFrame:
    """(business, word, freq) without stop words, numbers and empty tokens."""
    words = texts.select("business", F.explode(space_tokens(strip_punctuation(F.col("text")))).alias("word"))
    return words.where(~F.col("word").isin([*stopwords, ""]) & ~is_number(F.col("word"))).groupBy("business", "word").agg(F.count("*").alias("freq"))


def tfidf_profile(texts: DataFrame, stopwords: list[str], k: int = 200, idf_n: str = "vocabulary") -> DataFrame:
    """(business, word, freq, tfidf): the k highest words a business, ties by word.

    The idf numerator is the size of the vocabulary; ``idf_n="docs"`` takes the number of businesses.
    """
    counts = cut(word_counts(texts, stopwords))  # four times below, so texts are taken apart once
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("total")) if idf_n == "vocabulary" else counts.agg(F.countDistinct("business").alias("total"))
    most = counts.groupBy("business").agg(F.max("freq").alias("most"))
    scored = counts.join(most, "business").join(df, "word").join(F.broadcast(total))
    scored = scored.select("business", "word", "freq", F.round(F.col("freq") / F.col("most") * F.log2(F.col("total") / F.col("df")), 6).alias("tfidf"))
    rank = F.row_number().over(Window.partitionBy("business").orderBy(F.desc("tfidf"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def user_profile(visits: DataFrame, profile: DataFrame, k: int = 200) -> DataFrame:
    """(user, word, n): the k words with the highest summed counts over a user's visits.

    A business counts once a visit.
    """
    times = visits.groupBy("user", "business").agg(F.count("*").alias("times"))
    sums = times.join(profile, "business").groupBy("user", "word").agg(F.sum(F.col("times") * F.col("freq")).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("n"), "word"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def content_score(tests: DataFrame, users: DataFrame, profile: DataFrame, least: float = 0.01, form: str = "containment") -> DataFrame:
    """(user, business, score) of test pairs: shared words by the business' words, or their cosine."""
    nb = profile.groupBy("business").agg(F.count("*").alias("nb"))
    nu = users.groupBy("user").agg(F.count("*").alias("nu"))
    pairs = tests.select("user", "business").distinct()
    shared = pairs.join(users.select("user", "word"), "user").join(profile.select("business", "word"), ["business", "word"]).groupBy("user", "business").agg(F.count("*").alias("k"))
    below = F.col("nb") if form == "containment" else F.sqrt(F.col("nb")) * F.sqrt(F.col("nu"))
    return shared.join(nb, "business").join(nu, "user").select("user", "business", (F.col("k") / below).alias("score")).where(F.col("score") >= least)


def both_ways(model: DataFrame) -> DataFrame:
    """A symmetric model in both directions as (x, y, sim)."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return model.select(ends.alias("e"), "sim").select("e.x", "e.y", "sim")


def predict_by_items(train: DataFrame, tests: DataFrame, model: DataFrame, k: int = 10) -> DataFrame:
    """(user, item, stars): mean of the user's ratings of the k nearest items, weighted by similarity."""
    near = tests.select("user", "item").distinct().join(both_ways(model).withColumnsRenamed({"x": "item", "y": "other"}), "item")
    rated = near.join(train.select("user", F.col("item").alias("other"), "stars"), ["user", "other"])
    rank = F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc(F.round("sim", 9)), "other"))
    best = rated.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("user", "item").agg((F.sum(F.col("stars") * F.col("sim")) / F.sum("sim")).alias("stars")).where("stars > 0")


def predict_by_users(train: DataFrame, tests: DataFrame, model: DataFrame, k: int = 10) -> DataFrame:
    """(user, item, stars): the user's mean plus the k nearest raters' deviations, weighted by
    similarity; the mean alone where no near user rated the item."""
    means = train.groupBy("user").agg(F.avg("stars").alias("mean"))
    pairs = tests.select("user", "item").distinct().join(means, "user")
    near = pairs.join(both_ways(model).withColumnsRenamed({"x": "user", "y": "other"}), "user")
    rated = near.join(train.select(F.col("user").alias("other"), "item", "stars"), ["other", "item"]).join(means.select(F.col("user").alias("other"), F.col("mean").alias("other_mean")), "other")
    rank = F.row_number().over(Window.partitionBy("user", "item").orderBy(F.desc(F.round("sim", 9)), "other"))
    moved = rated.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("user", "item").agg((F.sum((F.col("stars") - F.col("other_mean")) * F.col("sim")) / F.sum("sim")).alias("shift"))
    return pairs.join(moved, ["user", "item"], "left").select("user", "item", (F.col("mean") + F.coalesce("shift", F.lit(0.0))).alias("stars")).where("stars > 0")
