"""A corpus pipeline over ``documents``: reject, deduplicate, decontaminate, redact, encode.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and
returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of docs.

Edge cases: rows with null texts count as empty texts; rows with a null doc_id are kept by
deduplication and judged by their texts in the other stages; of repeated doc_ids the row
of the least text digest stays after deduplication; empty tables go through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, decontam, ngram_join, quality, secrets
from millrace.llm.common import n_made, sweep, tuned, written


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score reaches the classifier's threshold."""
    labels = quality.learnable(tuned(spark).read.parquet(f"{sf_dir}/labels.parquet"), "quality", fold=2, folds=4)
    others = tuple(c for c in docs.columns if c != "doc_id")
    name = _free("score", docs)
    scored = quality.score(docs, quality.train(docs, labels), keep=others, out=name)
    return scored.where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every group of near-duplicates (five words, Jaccard of 0.8 or more)."""
    groups = ngram_join.near_duplicates(docs, n=5, num=8, den=10)
    dropped = groups.where("component_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    # of differing texts under one id the one with the least digest stays, whatever the order of rows
    first = F.min_by(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]), F.struct(F.sha2(F.coalesce("text", F.lit("")), 256), F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(first.alias("row")).select("row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, also with other numbers, units and names.

    A text alone decides, so rows are named by a digest of their text: also those with a null or repeated doc_id.
    """
    name = _free("key", docs)
    keyed = docs.withColumn(name, F.xxhash64(F.col("text")))
    found = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name)
    return keyed.join(found.select(F.col("doc_id").alias(name)).distinct(), name, "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a placeholder; n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    spans = _free("spans", docs)
    clean = secrets.scan(docs, secrets.train(docs), keep=others, redacted=True, out=(spans, "text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.size(spans) > 0, length).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and a digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    done = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return done.select("doc_id", F.floor(F.length("ids") / 4).alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE", encode_stage),
]

#: The classifier, the network and the tokenizer are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  What a stage wrote on its way is removed once its rows are written."""
    since, docs = n_made(), tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        sweep(since)
    return STAGES[-1][1](spark, docs, sf_dir)
