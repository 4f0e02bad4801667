"""Relational operators, text functions, sources and sinks on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.functions import hashing, text, vectors
from millrace.operators import relational
from millrace.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def reviews(spark):
    data = [(1, 10, 5.0, "1997-01-02 00:00:00"), (1, 11, 3.0, "1998-01-02 00:00:00"), (2, 10, 4.0, "1997-05-02 00:00:00"), (3, 12, 1.0, "1997-05-02 00:00:00")]
    return spark.createDataFrame(data, "user_id long, business_id long, stars double, date string").withColumn("date", F.to_timestamp("date"))


@pytest.fixture(scope="module")
def businesses(spark):
    return spark.createDataFrame([(10, "food, bar"), (11, "bar"), (12, None)], "business_id long, categories string")


def test_left_join_keeps_a_null_category(reviews, businesses):
    assert [tuple(r) for r in relational.category_average(reviews, businesses, 9).collect()] == [("food", 4.5), ("bar", 4.0), (None, 1.0)]


def test_early_sums_equal_the_inner_join(reviews, businesses):
    inner = rows(relational.category_average(reviews, businesses, 9, how="inner"))
    assert inner == rows(relational.category_average_early(reviews, businesses, 9)) == [("bar", 4.0), ("food", 4.5)]


def test_summary_top_and_having(reviews):
    assert tuple(relational.summary(reviews, 1997).first()) == (4, 3, 3, 3)
    assert [tuple(r) for r in relational.top_k(reviews, "user_id", 2).collect()] == [(1, 2), (2, 1)]
    assert rows(relational.count_over(reviews, "user_id", 1)) == [(1, 2)]


def test_partition_stats_show_empty_partitions(reviews):
    found = rows(relational.partition_stats(reviews, "business_id", 7))
    assert [p for p, _ in found] == list(range(7)) and sum(n for _, n in found) == 4


def test_top_words_strips_marks_from_words_only(spark):
    df = spark.createDataFrame([("The (cat), the cat! don't",), ("the cat's",), (None,), ("",)], "text string")
    assert [tuple(r) for r in relational.top_words(df, ["the"], 2).collect()] == [("cat", 2), ("cat's", 1)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a-b, c. 12", '{"s": {"t": 3}}', "1997-03-01 10:00:00")], "t string, j string, d string")
    got = df.select(text.strip_punctuation(F.col("t")), text.json_field(F.col("j"), "s.t"), text.year_of(F.col("d")), text.is_number(F.lit("12")), text.is_ascii_alpha(F.lit("é"))).first()
    assert tuple(got) == ("ab c 12", "3", 1997, True, False)


@pytest.mark.parametrize("word", ["a", "Zoë", "顧客", "x" * 60])
def test_byte_fold_equals_the_big_integer(spark, word):
    got = spark.range(1).select(hashing.utf8_mod(F.lit(word), 2454587)).first()[0]
    assert got == int(word.encode().hex(), 16) % 2454587


def test_trailing_zeros(spark):
    got = spark.createDataFrame([(0,), (1,), (8,), (12,)], "x long").select(hashing.trailing_zeros(F.col("x"))).collect()
    assert [r[0] for r in got] == [1, 0, 3, 2]


def test_distances(spark):
    a, b, v = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0)), F.array(F.lit(0.0), F.lit(4.0))
    assert tuple(spark.range(1).select(vectors.euclidean(a, b), vectors.mahalanobis(a, b, v)).first()) == (5.0, 2.0)


def test_readers_and_sinks_round_trip(spark, tmp_path):
    (tmp_path / "in.csv").write_text("user,item\n1,a\nuser,item\n2,b\n")
    pairs = readers.csv_with_header(spark, str(tmp_path / "in.csv"), "user string, item string")
    assert rows(pairs) == [("1", "a"), ("2", "b"), ("user", "item")]
    sinks.json_lines(pairs, str(tmp_path / "out"))
    assert rows(readers.json_lines(spark, str(tmp_path / "out"), "user string, item string")) == rows(pairs)
    sinks.csv(pairs, str(tmp_path / "csv"))
    assert rows(readers.csv_with_header(spark, str(tmp_path / "csv"), "user string, item string")) == rows(pairs)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b.txt").write_text("2,3.0,4.0\n")
    (tmp_path / "p" / "a.txt").write_text("1,1.0,2.0\n")
    assert [r["id"] for part in readers.point_rounds(spark, str(tmp_path / "p"), 2) for r in part.collect()] == [1, 2]
    (tmp_path / "w.txt").write_text(" The \nof\n\n")
    assert rows(readers.word_list(spark, str(tmp_path / "w.txt"))) == [("of",), ("the",)]


def test_broken_records_raise(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.json"), "a int").collect()


def test_reports(spark):
    sets = spark.createDataFrame([(["a"],), (["b"],), (["a", "b"],)], "items array<string>")
    assert sinks.itemset_report(sets, sets) == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')"
    members = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "node string, community int")
    assert [r["line"] for r in sinks.community_lines(members).collect()] == ["'c'", "'a', 'b'"]
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0)], "a string, b string, betweenness double")
    assert [r["line"] for r in sinks.betweenness_lines(edges).collect()] == ["('a', 'c'), 2.0", "('a', 'b'), 1.0"]
    assert sinks.true_false(spark.createDataFrame([(2, False), (1, True)], "i int, f boolean"), "i", "f") == "T F"
    assert json.loads(sinks.json_object(spark.createDataFrame([(1, "x")], "a int, b string"))) == {"a": 1, "b": "x"}


def test_json_documents_and_pair_models(spark, tmp_path):
    (tmp_path / "model.json").write_text('{\n "b1": ["x", "y"],\n "b2": ["z"]\n}')
    assert rows(readers.json_document(spark, str(tmp_path / "model.json"), "b1 array<string>, b2 array<string>")) == [(["x", "y"], ["z"])]
    sinks.pair_model(readers.in_memory(spark, [(1, 2, 0.5)], "a long, b long, sim double"), str(tmp_path / "pairs"))
    assert rows(readers.pair_model(spark, str(tmp_path / "pairs"), "long")) == [(1, 2, 0.5)]


def test_session_settings(spark):
    found = session.get_session()
    assert found.conf.get("spark.sql.session.timeZone") == "UTC" and session.shared_dir(found)
    assert session.cut(found.range(3)).count() == 3


def test_own_partitioner(spark):
    df = readers.in_memory(spark, [(k,) for k in (0, 7, 7, 14, 3)], "k long")
    assert rows(relational.partition_stats(df, "k", 7, F.pmod("k", F.lit(7)))) == [(0, 4), (1, 0), (2, 0), (3, 1), (4, 0), (5, 0), (6, 0)]
