"""The registered queries: operators over the logical views."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import is_ascii_alpha, json_field, mentions_year
from millrace.operators import cluster, graph, itemsets, recommend, relational, similarity, sketch
from millrace.plans.oracle import ORACLE_SQL  # noqa: F401  (part of this module's interface)
from millrace.plans.settings import (
    BASKET_SUPPORT, EDGE_THRESHOLD, JACCARD, K_MEANS, LSH_BANDS, LSH_JACCARD, PARTITIONS, SAMPLE_SIZE, STOPWORDS, SWAPPED_SUPPORT, USER_BANDS, YEAR,
)
from millrace.session import cut, shared_dir
from millrace.sources import readers, sinks, views
from millrace.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _fresh(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def category_avg(spark, d):
    return relational.category_average(views.reviews(spark, d), views.businesses(spark, d), 20)


@query
def category_avg_inner(spark, d):
    return relational.category_average(views.reviews(spark, d), views.businesses(spark, d), 20, how="inner")


@query
def category_avg_early(spark, d):
    return relational.category_average_early(views.reviews(spark, d), views.businesses(spark, d), 20)


@query
def review_stats(spark, d):
    return relational.summary(views.reviews(spark, d), YEAR)


@query
def mentions_of_year(spark, d):
    """Reviews whose date holds the year's digits anywhere."""
    return views.reviews(spark, d).where(mentions_year(F.col("date").cast("string"), YEAR)).agg(F.count("*").alias("n"))


@query
def count_by_year(spark, d):
    return relational.count_by(views.reviews(spark, d), F.year("date").alias("year"))


@query
def top_users(spark, d):
    return relational.top_k(views.reviews(spark, d), "user_id", 10)


@query
def top_words(spark, d):
    return relational.top_words(views.table(spark, d, "documents"), STOPWORDS, 50)


@query
def count_over(spark, d):
    return relational.count_over(views.table(spark, d, "orders"), "o_custkey", 15)


@query
def partition_stats(spark, d):
    return relational.partition_stats(views.reviews(spark, d), "business_id", PARTITIONS)


@query
def partition_by_id(spark, d):
    """Partitions chosen by a partitioner of one's own."""
    return relational.partition_stats(views.reviews(spark, d), "business_id", PARTITIONS, F.pmod("business_id", F.lit(PARTITIONS)))


@query
def partition_totals(spark, d):
    found = relational.partition_stats(views.reviews(spark, d), "business_id", PARTITIONS)
    return found.agg(F.count("*").alias("partitions"), F.sum("n").alias("n"))


def _itemset_rows(sets: DataFrame) -> DataFrame:
    return sets.select(F.size("items").alias("size"), F.array_join("items", ",").alias("items"), F.col("freq").cast("long").alias("freq"))


@query
def itemsets_brands(spark, d):
    pairs = views.baskets(spark, d)
    return _itemset_rows(itemsets.frequent_itemsets(pairs, BASKET_SUPPORT(pairs)))


@query
def itemsets_orders(spark, d):
    return _itemset_rows(itemsets.frequent_itemsets(views.baskets(spark, d, swap=True), SWAPPED_SUPPORT))


@query
def son_itemsets(spark, d):
    pairs = views.baskets(spark, d)
    return _itemset_rows(itemsets.son(pairs, BASKET_SUPPORT(pairs), PARTITIONS))


@query
def jaccard_pairs(spark, d):
    return similarity.jaccard_pairs(views.visits(spark, d), "user", "item", JACCARD).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def lsh_candidates(spark, d):
    return similarity.lsh_candidates(views.visits(spark, d), "item", "user", USER_BANDS)


@query
def lsh_pairs(spark, d):
    return similarity.lsh_pairs(views.visits(spark, d), "item", "user", LSH_BANDS, LSH_JACCARD).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def lsh_recall(spark, d):
    """How many pairs reach the threshold, and whether LSH finds nine in ten of them."""
    every = similarity.lsh_hits(views.visits(spark, d), "item", "user", LSH_BANDS, LSH_JACCARD)
    return every.agg(F.count("*").alias("n_pairs"), F.coalesce(F.avg(F.col("hit").cast("int")) >= 0.9, F.lit(True)).alias("reached"))


@query
def item_pearson(spark, d):
    return similarity.pearson_pairs(views.ratings(spark, d), "item", "user").select("a", "b", F.round("sim", 6).alias("sim"))


@query
def user_pearson(spark, d):
    return similarity.user_pearson(views.ratings(spark, d), USER_BANDS).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def tfidf_profile(spark, d):
    return recommend.tfidf_profile(views.texts(spark, d), STOPWORDS)


@query
def user_profile(spark, d):
    texts = views.texts(spark, d)
    return recommend.user_profile(texts, recommend.tfidf_profile(texts, STOPWORDS))


def _profiles(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Visits, and the profiles of businesses and of their users; the first are written once, since both need them."""
    texts = views.texts(spark, d)
    profile = cut(recommend.tfidf_profile(texts, STOPWORDS))
    return texts, recommend.user_profile(texts, profile), profile


@query
def content_score(spark, d):
    return recommend.content_score(*_profiles(spark, d)).select("user", "business", F.round("score", 6).alias("score"))


@query
def content_saved(spark, d):
    """Profiles written by one job and read by another that scores."""
    texts, users, profile = _profiles(spark, d)
    at = _fresh(spark, "profiles")
    sinks.json_lines(users, f"{at}/users")
    sinks.json_lines(profile, f"{at}/businesses")
    users = readers.json_lines(spark, f"{at}/users", "user long, word string, n long")
    profile = readers.json_lines(spark, f"{at}/businesses", "business string, word string, freq long, tfidf double")
    return recommend.content_score(texts, users, profile).select("user", "business", F.round("score", 6).alias("score"))


@query
def item_cf_predict(spark, d):
    train, tests = views.ratings(spark, d, test=False), views.ratings(spark, d, test=True)
    model = similarity.pearson_pairs(train, "item", "user")
    return recommend.predict_by_items(train, tests, model).select("user", "item", F.round("stars", 5).alias("stars"))


@query
def item_cf_saved(spark, d):
    """The same with the model of pairs written by one job and read by another that predicts."""
    train, tests = views.ratings(spark, d, test=False), views.ratings(spark, d, test=True)
    at = _fresh(spark, "pairs")
    sinks.pair_model(similarity.pearson_pairs(train, "item", "user"), at)
    model = readers.pair_model(spark, at, "long")
    return recommend.predict_by_items(train, tests, model).select("user", "item", F.round("stars", 5).alias("stars"))


def _sql_round(name: str, digits: int) -> Column:
    """A column of doubles rounded as the SQL twins do it: times ten to the digits, to the nearest whole number, and back.

    Spark's own rounding cuts at the shortest decimal form, so that 1.5943749999999999, a half but for the last bit, goes down there and up in SQL.
    """
    return F.round(F.col(name) * 10.0**digits) / 10.0**digits


@query
def user_cf_predict(spark, d):
    train, tests = views.ratings(spark, d, test=False), views.ratings(spark, d, test=True)
    model = similarity.user_pearson(train, USER_BANDS)
    return recommend.predict_by_users(train, tests, model).select("user", "item", _sql_round("stars", 5).alias("stars"))


def _names(spark, d) -> DataFrame:
    names = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return names.union(readers.in_memory(spark, [(-1, ""), (-2, "Zoë Müller"), (-3, "顧客"), (-4, None)], "id long, name string"))


def _bits(spark, d) -> DataFrame:
    return sketch.bloom_bits(views.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name")))


@query
def bloom_bits(spark, d):
    return _bits(spark, d)


@query
def bloom_probe(spark, d):
    return sketch.bloom_probe(_names(spark, d), _bits(spark, d)).select("id", "present")


def _days(spark, d) -> DataFrame:
    return views.events(spark, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")


@query
def fm_reference(spark, d):
    return sketch.fm_estimate(_days(spark, d), "user_id", "day").select("day", "n_distinct", F.round("estimate", 6).alias("estimate"))


@query
def fm_standard(spark, d):
    return sketch.fm_estimate(_days(spark, d), "user_id", "day", form="power").select("day", "n_distinct", F.round("estimate", 6).alias("estimate"))


@query
def hll_distinct(spark, d):
    return _days(spark, d).groupBy("day").agg(F.approx_count_distinct("user_id", 0.02).alias("estimate"))


@query
def reservoir_sample(spark, d):
    return sketch.reservoir(views.table(spark, d, "events").select("event_id", "event_type"), "event_id", SAMPLE_SIZE)


@query
def reservoir_top(spark, d):
    """The most frequent values of the sample."""
    sample = sketch.reservoir(views.table(spark, d, "events").select("event_id", "event_type"), "event_id", SAMPLE_SIZE)
    return sketch.top_frequencies(sample, "event_type", 3)


@query
def hll_within_error(spark, d):
    """Exact distinct users a day, and whether HyperLogLog comes within five times its standard error."""
    both = _days(spark, d).groupBy("day").agg(F.countDistinct("user_id").alias("n_distinct"), F.approx_count_distinct("user_id", 0.02).alias("estimate"))
    return both.select("day", "n_distinct", (F.abs(F.col("estimate") - F.col("n_distinct")) <= F.greatest(F.lit(2), F.col("n_distinct") * 0.1)).alias("within"))


@query
def top_frequencies(spark, d):
    tags = views.table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("tag")).where(is_ascii_alpha(F.col("tag")))
    return sketch.top_frequencies(tags, "tag", 3)


@query
def sliding_distinct(spark, d):
    found = windows.sliding_distinct(views.events(spark, d), "user_id", "1 hour", "20 minutes")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query
def sliding_fm(spark, d):
    found = windows.sliding_fm(views.events(spark, d), "event_type", "1 hour", "20 minutes")
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_distinct", F.round("estimate", 6).alias("estimate"))


@query
def kmeans(spark, d):
    return cluster.kmeans(views.points(spark, d), K_MEANS).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query
def kmeans_assign(spark, d):
    points = views.points(spark, d)
    return cluster.assign(points, cluster.first_points(points, K_MEANS)).select("id", "cluster", F.round("distance", 6).alias("distance"))


@query
def cluster_stats(spark, d):
    labelled = views.table(spark, d, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("features"))
    flat = cluster.cluster_stats(labelled).select("cluster", "n", F.posexplode(F.arrays_zip("sums", "squares")).alias("pos", "v"))
    return flat.select("cluster", "n", "pos", F.round("v.sums", 5).alias("total"), F.round("v.squares", 5).alias("squares"))


@query
def bfr(spark, d):
    points = views.points(spark, d)
    rounds = [points.where(F.col("id") % 5 == k) for k in range(5)]
    return cluster.bfr(rounds, K_MEANS, 64)[0]


def _graph(spark, d) -> DataFrame:
    members = views.visits(spark, d)
    return graph.cooccurrence_edges(members, "user", "item", EDGE_THRESHOLD)


@query
def copurchase_edges(spark, d):
    return _graph(spark, d)


@query
def jaccard_edges(spark, d):
    return graph.jaccard_edges(views.visits(spark, d), "user", "item", JACCARD)


@query
def graph_degrees(spark, d):
    return graph.degrees(_graph(spark, d))


@query
def label_propagation(spark, d):
    return graph.label_propagation(_graph(spark, d), 5)


@query
def connected_components(spark, d):
    return graph.connected_components(_graph(spark, d))


@query
def edge_betweenness(spark, d):
    return graph.edge_betweenness(_graph(spark, d)).select("a", "b", F.round("betweenness", 6).alias("betweenness"))


@query
def modularity(spark, d):
    edges = _graph(spark, d)
    groups = graph.connected_components(edges).select("node", F.col("component").alias("community"))
    return graph.modularity(edges, groups).select(F.round("modularity", 6).alias("modularity"))


@query
def girvan_newman(spark, d):
    return graph.girvan_newman(_graph(spark, d))


@query
def graph_links(spark, d):
    return graph.both_directions(_graph(spark, d))


@query
def graph_vertices(spark, d):
    return graph.vertices(_graph(spark, d))


@query
def modularity_unhalved(spark, d):
    edges = _graph(spark, d)
    groups = graph.connected_components(edges).select("node", F.col("component").alias("community"))
    return graph.modularity(edges, groups, divisor=1.0).select(F.round("modularity", 6).alias("modularity"))


@query
def content_cosine(spark, d):
    found = recommend.content_score(*_profiles(spark, d), form="cosine")
    return found.select("user", "business", F.round("score", 6).alias("score"))


@query
def tfidf_by_documents(spark, d):
    return recommend.tfidf_profile(views.texts(spark, d), STOPWORDS, idf_n="docs")


@query
def minhash_signatures(spark, d):
    return similarity.minhash(views.visits(spark, d), "item", "user", USER_BANDS).select(F.col("o").alias("item"), "band", "sig")


@query
def bfr_rounds(spark, d):
    points = views.points(spark, d)
    counters = cluster.bfr([points.where(F.col("id") % 5 == k) for k in range(5)], K_MEANS, 64)[1]
    return spark.createDataFrame([tuple(c.values()) for c in counters], "round long, ds_clusters long, ds_points long, cs_clusters long, cs_points long, rs_points long")


@query
def bfr_totals(spark, d):
    """Points in discard, compression and retained sets together, a row a round."""
    return bfr_rounds(spark, d).select("round", F.expr("ds_points + cs_points + rs_points").alias("n_points"))


@query
def edge_list_csv(spark, d):
    """Edges from a CSV of two columns with a header, both directions and loops in it."""
    at = _fresh(spark, "edges")
    edges = _graph(spark, d)
    sinks.csv(edges.union(edges.select("b", "a")).union(edges.select("a", F.col("a").alias("b"))), at)
    return graph.edges_of(readers.csv_with_header(spark, at, "a long, b long"), "a", "b")


@query
def sliding_hll(spark, d):
    found = windows.sliding_distinct(views.events(spark, d), "user_id", "1 hour", "20 minutes", exact=False)
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n")


@query
def event_fields(spark, d):
    events = views.table(spark, d, "events").select(json_field(F.col("props"), "k").cast("long").alias("k"), "value")
    return events.groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query
def top_tags_by_type(spark, d):
    tags = views.table(spark, d, "part").select("p_type", F.explode(F.split("p_name", " ")).alias("tag"))
    return sketch.dense_top(tags, "p_type", "tag", 3).select("p_type", "tag", "n", "rank")


@query
def json_lines_round_trip(spark, d):
    """Reviews written as JSON lines in the shared folder and read back by their schema."""
    path = _fresh(spark, "json")
    sinks.json_lines(views.reviews(spark, d).select("user_id", "business_id", "stars"), path)
    back = readers.json_lines(spark, path, "user_id long, business_id long, stars double")
    return back.groupBy("stars").agg(F.count("*").alias("n"), F.sum("user_id").alias("users"), F.sum("business_id").alias("businesses"))
