"""The box parser on broken and hostile bytes, and its tables against a plain reading."""

import random
import struct
import time

import pytest

from millrace.llm import media


def box(kind, *parts):
    return struct.pack(">I4s", 8 + sum(map(len, parts)), kind) + b"".join(parts)


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


def u32(*values):
    return struct.pack(f">{len(values)}I", *values)


def movie(tables, body=b"", duration=100, timescale=10):
    """A file whose sample tables and media bytes are as given."""
    entry = full(b"stsd", u32(1), box(b"mp4a", bytes(28)))
    mdhd = full(b"mdhd", u32(0, 0, timescale, duration), bytes(4))
    return box(b"mdat", body) + box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", u32(0), b"soun", bytes(12)), box(b"minf", box(b"stbl", entry, *tables)))))


@pytest.mark.parametrize("seed", range(40))
def test_sample_tables_equal_a_plain_reading(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 60)
    sizes = [rng.randint(0, 9)] * n if rng.random() < 0.4 else [rng.randint(0, 9) for _ in range(n)]
    per, left = [], n
    while left:
        per.append(min(left, rng.choice([1, 2, 2, 5])))
        left -= per[-1]
    body, offsets, starts, at = b"", [], [], 0
    for count in per:
        body += rng.randbytes(rng.randint(0, 4))
        offsets.append(8 + len(body))
        for _ in range(count):
            starts.append(8 + len(body))
            body += rng.randbytes(sizes[at])
            at += 1
    runs = [(i + 1, c) for i, c in enumerate(per) if not i or c != per[i - 1]]
    uniform = len(set(sizes)) == 1 and sizes[0]
    stsz = full(b"stsz", u32(sizes[0], n)) if uniform else full(b"stsz", u32(0, n, *sizes))
    chunks = full(b"stco", u32(len(offsets), *offsets)) if rng.random() < 0.5 else full(b"co64", u32(len(offsets)), struct.pack(f">{len(offsets)}Q", *offsets))
    tables = [full(b"stts", u32(1, n, 1)), full(b"stsc", u32(len(runs)), *(u32(a, c, 1) for a, c in runs)), stsz, chunks]
    sync = sorted(rng.sample(range(n), rng.randint(0, n)))
    listed = rng.random() < 0.7
    if listed:
        tables.append(full(b"stss", u32(len(sync), *(s + 1 for s in sync))))
    data = movie(tables, body)
    found = media.describe(data)
    assert (found["codec"], found["n_samples"], found["duration_ms"]) == ("mp4a", n, 10000)
    assert media.stored_samples(data, found) == b"".join(data[a : a + s] for a, s in zip(starts, sizes))
    keys = list(zip(found["key_offsets"].tolist(), found["key_sizes"].tolist()))
    if listed:
        assert keys == [(starts[s], sizes[s]) for s in sync]
    else:
        assert b"".join(data[a : a + s] for a, s in keys) == media.stored_samples(data, found)


ONE = [full(b"stsc", u32(1, 1, 1, 1)), full(b"stsz", u32(0, 1, 4)), full(b"stco", u32(1, 8))]


@pytest.mark.parametrize("name,data", [
    ("nested", box(b"moov") * 0 + b"".join(struct.pack(">I4s", 8 * (3000 - k), b"moov") for k in range(3000))),
    ("counts", movie([full(b"stsc", u32(1, 1, 1, 1)), full(b"stsz", u32(1, 4_000_000_000)), full(b"stco", u32(1, 8))], b"abcd")),
    ("table", movie([full(b"stsc", u32(1, 1, 1, 1)), full(b"stsz", u32(0, 4_000_000_000)), full(b"stco", u32(1, 8))], b"abcd")),
    ("sync of 0", movie([*ONE, full(b"stss", u32(1, 0))], b"abcd")),
    ("sync beyond", movie([*ONE, full(b"stss", u32(1, 2))], b"abcd")),
    ("run of 0", movie([full(b"stsc", u32(1, 0, 1, 1)), *ONE[1:]], b"abcd")),
    ("falling runs", movie([full(b"stsc", u32(2, 2, 1, 1, 1, 1, 1)), *ONE[1:]], b"abcd")),
    ("offset", movie([*ONE[:2], full(b"co64", u32(1), struct.pack(">Q", 2**64 - 1))], b"abcd")),
    ("sum of sizes", movie([full(b"stsc", u32(1, 1, 2, 1)), full(b"stsz", u32(0, 2, 400, 400)), full(b"stco", u32(1, 0))], b"abcd")),
    ("many tracks", box(b"moov", box(b"trak") * 100_000)),
])
def test_hostile_files(name, data):
    began = time.perf_counter()
    found = media.describe(data)
    assert found is None or (name == "many tracks" and found["n_samples"] == 0)
    assert time.perf_counter() - began < 2


def test_long_durations():
    wide = movie(ONE, b"abcd").replace(full(b"mdhd", u32(0, 0, 10, 100), bytes(4)), full(b"mdhd", u32(0, 0, 10, 100), bytes(4)))
    assert media.describe(wide)["duration_ms"] == 10000
    version_1 = box(b"mdhd", b"\x01\0\0\0", bytes(16), struct.pack(">IQ", 1, 2**64 - 1), bytes(4))
    huge = box(b"mdat", b"abcd") + box(b"moov", box(b"trak", version_1, *ONE))
    assert media.describe(huge) is None


@pytest.mark.parametrize("seed", range(6))
def test_any_bytes_give_a_result_or_null(spark, seed):
    rng = random.Random(seed)
    good = media.encode_container(rng.randbytes(64 * 40))
    tail = good.rindex(b"moov") - 4
    rows = []
    for k in range(400):
        data = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(tail, len(data)) if rng.random() < 0.9 else rng.randrange(len(data))
            data[at] = rng.choice([0, 1, 0x7F, 0xFF, rng.randrange(256)])
        if rng.random() < 0.2:
            del data[rng.randrange(len(data)) :]
        rows.append((k, rng.randbytes(rng.randint(0, 80)) if rng.random() < 0.1 else bytes(data)))
    table = spark.createDataFrame([*rows, (None, None)], "doc_id long, media binary")
    assert media.media_features(table).count() == media.media_features(table, digests=True).count() == 401
