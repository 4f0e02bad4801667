"""Streams of files must give what the batch form gives."""

import re
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.sketch import frequency_report, reservoir, top_frequencies
from millrace.operators.sketch import bloom_bits
from millrace.sources import readers, sinks
from millrace.streaming import run, windows


def _drain(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()


def test_sliding_distinct_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = readers.file_stream(spark, str(tmp_path / "in"), events.schema, "parquet")
    _drain(windows.sliding_distinct(stream, "user_id", "1 day", "8 hours"), "sliding")
    got = {tuple(r) for r in spark.table("sliding").collect()}
    want = {tuple(r) for r in windows.sliding_distinct(events, "user_id", "1 day", "8 hours").collect()}
    assert got <= want and len(got) >= len(want) - 8  # the last windows are still open


def test_bloom_stream(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text('{"name": "ada"}\n{"name": "bob"}\n{"name": ""}\n')
    stream = readers.file_stream(spark, str(tmp_path / "n"), "name string")
    bits = bloom_bits(spark.createDataFrame([("ada",)], "name string"))
    _drain(windows.stream_bloom(stream, bits), "bloom")
    assert {tuple(r) for r in spark.table("bloom").collect()} == {("ada", True), ("bob", False), ("", True)}


def test_reservoir_and_fm_batches(spark, tmp_path):
    (tmp_path / "e").mkdir()
    for k in range(3):
        (tmp_path / "e" / f"{k}.json").write_text("".join(f'{{"id": {i}, "v": "x{i % 7}"}}\n' for i in range(50 * k, 50 * k + 50)))
    keep = windows.ReservoirSink(str(tmp_path / "sample"), "id", 20)
    note = windows.fm_batches(sinks.append_batches(str(tmp_path / "fm")), "v")

    def both(batch, batch_id):
        keep(batch, batch_id)
        note(batch, batch_id)

    stream = readers.file_stream(spark, str(tmp_path / "e"), "id long, v string", per_batch=1)
    stream.writeStream.foreachBatch(both).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    sample = [r["id"] for r in keep.sample(spark).collect()]
    assert len(set(sample)) == 20 and max(sample) >= 50
    fm = spark.read.option("header", True).csv(str(tmp_path / "fm"))
    assert [r["n_distinct"] for r in fm.collect()] == ["7", "7", "7"]


@pytest.fixture
def lines():
    """A server that sends lines to whoever connects, and then stays silent."""
    server = socket.create_server(("127.0.0.1", 0))
    sent = [f'{{"id": {i}, "city": "c{i % 5}"}}' for i in range(40)]

    def serve():
        with server.accept()[0] as peer:
            peer.sendall(("\n".join(sent) + "\n").encode())
            done.wait(60)

    done = threading.Event()
    thread = threading.Thread(target=serve, daemon=True)
    thread.start()
    yield server.getsockname()[1]
    done.set()
    server.close()


def test_socket_stream_through_micro_batches(spark, tmp_path, lines):
    """Lines from a socket, in micro-batches, to stamped truth and estimate in CSV files; started, awaited, stopped."""
    stream = readers.socket_lines(spark, "127.0.0.1", lines).select(F.from_json("value", "id long, city string").alias("r")).select("r.*")
    out = str(tmp_path / "fm")
    query = run.micro_batches(stream, windows.fm_batches(sinks.append_batches(out), "city", stamped=True), str(tmp_path / "cp"), every="1 seconds")
    found, end = [], time.time() + 60
    while not found and time.time() < end:
        time.sleep(1)
        if any(p["numInputRows"] for p in query.recentProgress):
            found = spark.read.option("header", True).csv(out).collect()
    run.stop(query)
    assert not query.isActive
    assert found and all(int(r["n_distinct"]) <= 5 and re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", r["time"]) for r in found)


def test_drained_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"v": "x"}\n{"v": "y"}\n')
    run.drain(readers.file_stream(spark, str(tmp_path / "in"), "v string"), windows.fm_batches(sinks.append_batches(str(tmp_path / "out")), "v"), str(tmp_path / "cp"))
    assert [r["n_distinct"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == ["2"]


def test_reservoir_goes_on_after_a_restart_and_reports_its_sample(spark, tmp_path):
    """A new sink in the same folder keeps the sample; ids beyond 32 bits; a batch that runs again changes nothing."""
    path = str(tmp_path / "sample")
    batches = [spark.range(k * 1_000_000_000, k * 1_000_000_000 + 300).select("id", F.concat(F.lit("t"), F.col("id") % 4).alias("tag")) for k in range(5)]
    for n, batch in enumerate(batches):
        windows.ReservoirSink(path, "id", 100, value="tag")(batch, n)
    windows.ReservoirSink(path, "id", 100, value="tag")(batches[4], 4)
    sink = windows.ReservoirSink(path, "id", 100, value="tag")
    every = batches[0]
    for batch in batches[1:]:
        every = every.union(batch)
    sample = sink.sample(spark)
    assert {r["id"] for r in sample.collect()} == {r["id"] for r in reservoir(every, "id", 100).collect()}
    shares = [sum(k * 10**9 <= r["id"] < k * 10**9 + 300 for r in sample.collect()) for k in range(5)]
    assert sum(shares) == 100 and min(shares) >= 8
    want = frequency_report(1500, [tuple(r) for r in top_frequencies(sample, "tag", 3).collect()])
    assert (tmp_path / "sample" / "report=00000004").is_dir()
    assert "\n".join(r["value"] for r in spark.read.text(f"{path}/report=00000004").collect()).strip() == want.strip()
    assert want.startswith("The number of tweets with tags from the beginning: 1500\n") and windows.ReservoirSink(path + "2", "id")._last(spark) == -1
