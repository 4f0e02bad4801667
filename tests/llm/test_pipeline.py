"""The pipeline's stages, each on its own input, against plain versions."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from millrace.llm import byte_bpe, secrets
from millrace.llm.common import filesystem, n_made, sweep, written
from tests.llm.test_joins import brute

SF = "/root/testdata/sf0.01"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), "test-stage"))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert kept[-1].columns == docs.columns, name
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    good = [i for i in ids[0] if labels.get(i) == 1]
    assert sum(i in ids[1] for i in good) > 0.97 * len(good)
    assert sum(i in ids[1] for i in ids[0] if labels.get(i) == 0) <= 0.2 * sum(labels.get(i) == 0 for i in ids[0])
    rows = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    assert ids[2] == {c for _, c in brute(rows, 5, 8, 10).values()}
    assert ids[3] <= ids[2] and ids[4] == ids[3] == ids[5]
    before = {r["doc_id"]: r["text"] for r in kept[3].collect()}
    for r in kept[4].collect():
        base = secrets.base_spans(before[r["doc_id"]])
        assert not base or secrets.PLACEHOLDER in r["text"]
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in kept[4].collect()}
    for r in kept[5].collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(enc.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_odd_and_empty_tables(spark, stage):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "x"), (6, "long " * 30000)]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 1, 2, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, count long, score int, spans string, redacted string")
    assert stage(spark, docs.limit(0), SF).count() == 0
    got = stage(spark, docs, SF).collect()
    if stage is corpus_pipeline.quality_stage:
        assert len(got) <= 7
    else:
        assert len(got) == (5 if stage is corpus_pipeline.dedup_stage else 7)


def test_sweeping_leaves_the_last_table(spark):
    other, since = written(spark.range(2), "other"), n_made()
    first, last = written(spark.range(3), "first"), written(spark.range(4), "last")
    paths = [df.inputFiles()[0] for df in (other, first, last)]
    sweep(since)
    assert other.count() == 2 and last.count() == 4
    for path, there in zip(paths, (True, False, True)):
        store, local = filesystem(path)
        assert (store.get_file_info(local).type.name != "NotFound") == there
