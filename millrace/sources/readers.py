"""Typed readers.  Schemas are explicit and broken records raise (FAILFAST)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REVIEW = "user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, categories string"
PAIR_MODEL = "b1 string, b2 string, sim double"
NAMES = "name string"


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON object a line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A file that is one JSON document, such as a model of maps."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def pair_model(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """A model of pairs that was written as JSON lines, as (a, b, sim) with ids of a kind."""
    return json_lines(spark, path, PAIR_MODEL).select(F.col("b1").cast(kind).alias("a"), F.col("b2").cast(kind).alias("b"), "sim")


def csv_with_header(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV whose first line is a header; data lines that look like it stay."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def points(spark: SparkSession, path: str | list[str], dims: int) -> DataFrame:
    """Headerless CSV ``id, f1, ..., fd`` as (id, features)."""
    columns = [f"f{i}" for i in range(dims)]
    rows = spark.read.schema("id long, " + ", ".join(f"{c} double" for c in columns)).option("mode", "FAILFAST").csv(path)
    return rows.select("id", F.array(*columns).alias("features"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """One word a line, trimmed and lower-cased."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def point_rounds(spark: SparkSession, folder: str, dims: int) -> Iterator[DataFrame]:
    """The files of a folder as rounds, in the order of their names; only names reach the driver."""
    files = spark.read.format("binaryFile").load(folder).select("path").orderBy("path")
    for row in files.toLocalIterator():
        yield points(spark, row["path"], dims)


def in_memory(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """A stream of text lines from a socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_stream(spark: SparkSession, path: str, schema: str | StructType, form: str = "json", per_batch: int | None = None) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    reader = spark.readStream.schema(schema).format(form)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).load(path)
