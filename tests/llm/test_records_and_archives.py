"""Token records, media containers, WARC archives and byte-level BPE: exact round trips."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, media, token_records, warc
from millrace.llm.common import WordCache, bit_table, by_group, filesystem, in_table, ragged_take

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = list("abcXYZ éÜßñ'’sT14½²٣.,:;!?|&%$#*()-\"\t\n\r\x1c\x85\xa0 ​́İıſΣς漢カ🙂<>_") + ["<|endoftext|>", "'s", "'re", "  "]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def docs(spark, rows):
    """Documents with a column whose name clashes with the operators' own."""
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")


EDGES = [(3, "some text, twice"), (3, "some text, twice"), (1, None), (2, ""), (None, "no id"), (9, "long " * 30000), (7, "tie"), (8, "tie")]


def test_word_cache_forgets_without_changing_results():
    cache = WordCache(lambda words: [np.full(len(w), ord(w[0])) for w in words], "int64", limit=5)
    for k in range(0, 40, 4):
        words = [chr(97 + (k + j) % 26) * (j + 1) for j in range(4)]
        flat, lengths = cache.take(cache.codes(words))
        assert lengths.tolist() == [1, 2, 3, 4] and flat.tolist() == [ord(w[0]) for w in words for _ in w]


def test_helpers(spark):
    assert ragged_take(np.array([5, 0]), np.array([2, 3])).tolist() == [5, 6, 0, 1, 2]
    assert by_group(np.array([1, 2, 3]), np.array([2, 0, 1])).tolist() == [3, 0, 3]
    table = bit_table(spark.createDataFrame([(5,), (-3,), (1 << 40,), (None,)], "v long"), "v")
    assert in_table(table, np.array([5, -3, 1 << 40, 6])).tolist() == [True, True, True, False]


def test_crc32c():
    data = [b"123456789", b"", bytes(32), b"a" * 1000]
    assert token_records.crc32c(data).tolist()[:3] == [0xE3069283, 0, 0x8A9136AA]
    assert token_records.crc32c(data[:1])[0] == token_records.crc32c(data)[0]


def test_encoding_equals_the_tokenizer():
    t = Tokenizer.from_file(WORD_BPE)
    t.encode_special_tokens = True
    texts = odd_texts(2000)
    got = token_records.encode_texts(texts, WORD_BPE)
    assert all(a.tolist() == t.encode(x, add_special_tokens=False).ids for x, a in zip(texts, got))


def test_a_word_is_encoded_once_whatever_its_case_and_punctuation(monkeypatch):
    sent, encode = [], token_records._Chunks._encode
    monkeypatch.setattr(token_records, "_ENCODERS", {})
    monkeypatch.setattr(token_records._Chunks, "_encode", lambda self, words, **form: sent.extend(" ".join(words).split()) or encode(self, words, **form))
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(50)]
    texts = [" ".join(form(w) + tail for w in words) for tail in ("", ".", ",", "!!") for form in (str, str.upper, str.title)]
    t = Tokenizer.from_file(WORD_BPE)
    for text in texts + ["", " ", "\n" + texts[0] + "\x1c" + texts[1]]:
        got = token_records.encode_texts([text], WORD_BPE)
        assert got[0].tolist() == t.encode(text, add_special_tokens=False).ids
    plain = [w.lower() for w in sent if w.isalpha()]
    assert len(plain) <= len(words) + 2  # the two beside \x1c stand in a chunk of their own


def test_token_records(spark):
    t = Tokenizer.from_file(WORD_BPE)
    manifest = token_records.write_records(docs(spark, EDGES), WORD_BPE, 2)
    rows = sorted(token_records.read_records(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 3, 7, 8, 9]
    start, texts = 0, {i: x or "" for i, x in EDGES}
    for r in rows:
        ids = np.array([*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    shard = manifest.orderBy("part").first()
    assert token_records.read_at(shard["shard"], shard["index"], 0)[0] is None
    empty = token_records.write_records(docs(spark, EDGES).limit(0), WORD_BPE, 2)
    assert token_records.read_records(empty).count() == 0


def test_broken_records_raise(tmp_path):
    record = bytearray(token_records.frame([token_records.pack(1, np.array([70000], np.uint32))])[0])
    assert token_records.unpack(bytes(record[12:-4]))[1].tolist() == [70000]
    record[15] ^= 1
    for data in (record, record[:20]):
        (tmp_path / "r").write_bytes(data)
        with pytest.raises(ValueError), open(tmp_path / "r", "rb") as f:
            list(token_records.unframe(f))


def test_media(spark):
    made = media.encode_media(docs(spark, EDGES))
    got = media.media_features(made, keep=("doc_id", "n_bytes"), digests=True).collect()
    texts = {i: x or "" for i, x in EDGES}
    assert len(got) == len(EDGES)
    for r in got:
        data = texts[r["doc_id"]].encode()
        stored = data + bytes(-len(data) % 64 if data else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]))
    assert len({r["media_sha256"] for r in got if r["doc_id"] in (7, 8)}) == 1
    plain = media.media_features(made).collect()
    assert all(r["codec"] == "raw" and r["duration_ms"] == 40 * r["n_samples"] and len(r["key_offsets"]) == -(-r["n_samples"] // 32) for r in plain)


def test_media_boxes():
    payload = bytes(range(256)) * 1000
    data = media.encode_container(payload)
    found = media.describe(data)
    assert found["n_samples"] == 4000 and media.stored_samples(data, found) == payload
    assert data[found["key_offsets"][1] : found["key_offsets"][1] + 64] == payload[32 * 64 : 33 * 64]
    moov_first = data[data.rindex(b"moov") - 4 :]
    assert media.parse_container(moov_first)[0].codec == "raw"
    for broken in (None, b"", b"abc", data[:100], data[:-10]):
        assert media.describe(broken) is None


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nx", "Zoë " * 5000), (6, "u", "tie")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    written = warc.write_warc(pages)
    for r in written.collect():
        store, path = filesystem(r["archive"])
        with store.open_input_stream(path, compression=None) as f:
            data = f.read()
        z = zlib.decompressobj(31)
        z.decompress(data)
        assert not z.unused_data  # one member for the whole file
    archives = warc.normalise_all(written)
    got = {r["page_id"]: r for r in warc.read_warc(archives, payloads=True).collect()}
    first = {}
    for i, _, h in rows:
        first[h or ""] = i
    for i, _, h in rows:
        data, to = (h or "").encode(), first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want = (len(data), digest, "response" if to == i else "revisit", None if to == i else to, data if to == i else None)
        assert tuple(got[i])[1:5] == want[:4] and (got[i]["payload"] == want[4] if want[4] is None else bytes(got[i]["payload"]) == want[4])
    found = [x for a in archives.collect() if (x := warc.read_one(a["archive"], a["index"], 5))]
    assert len(found) == 1 and found[0]["payload"] == rows[4][2].encode()
    plain = warc.read_warc(warc.normalise_all(warc.write_warc(pages, dedup=False))).collect()
    assert {r["record_type"] for r in plain} == {"response"}
    assert warc.read_warc(warc.normalise_all(warc.write_warc(pages.limit(0)))).count() == 0
    odd = spark.createDataFrame([(None, "u", "same"), (1, "u", "same"), (1, "u", "same"), (1, "v", "other"), (2, "w", "same")], "page_id long, url string, html string")
    found = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.normalise_all(warc.write_warc(odd))).collect()), key=str)
    assert found == sorted([(None, 4, "response", None), (1, 4, "revisit", 2), (1, 4, "revisit", 2), (1, 5, "response", None), (2, 4, "response", None)], key=str)


def test_cut_archives_raise(tmp_path):
    whole = gzip.compress(warc.record(1, "u", b"abc", warc.digest(b"abc"), None))
    (tmp_path / "a").write_bytes(whole[:-12])
    (tmp_path / "b").write_bytes(gzip.compress(b"no record\r\n\r\n"))
    for name in "ab":
        with pytest.raises((ValueError, zlib.error)):
            warc.normalise(str(tmp_path / name), str(tmp_path / "out"), str(tmp_path / "idx"))


def test_byte_bpe_equals_tiktoken(spark):
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(BYTE_BPE), special_tokens={})
    rows = [*EDGES, *((100 + k, x) for k, x in enumerate(odd_texts(400, 2)))]
    done = byte_bpe.decode(byte_bpe.encode(docs(spark, rows), BYTE_BPE, public_tokenizers.PATTERN), BYTE_BPE).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted(((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in done), key=key)
    assert got == sorted(((i, np.array(want.encode_ordinary(x or ""), "<u4").tobytes(), (x or "").encode()) for i, x in rows), key=key)
    assert byte_bpe.encode(docs(spark, EDGES).limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_over_many_blocks(spark):
    rows = [(k, x) for k, x in enumerate(odd_texts(60, 3))]
    words = byte_bpe.pre_tokenise(docs(spark, rows).coalesce(1), public_tokenizers.PATTERN, 3, block_chars=100)
    assert words.select("block").distinct().count() > 5
    got = {r["doc_id"]: byte_bpe.decode_ids(np.frombuffer(r["ids"], "<u4"), BYTE_BPE).decode() for r in byte_bpe.reassemble(byte_bpe.encode_words(words, BYTE_BPE, public_tokenizers.PATTERN)).collect()}
    assert got == dict(rows)


def test_bpe_cuts_as_tiktoken_over_all_of_unicode(spark):
    """Also where the two pattern libraries know different versions of Unicode."""
    rng = random.Random(3)
    others = byte_bpe.stand_ins(public_tokenizers.PATTERN)
    anything = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for k in range(20_000):
        pool = anything if k % 2 or not others else list(map(chr, rng.sample(sorted(others), 20)))
        texts.append("".join(rng.choice(pool) if rng.random() < 0.6 else rng.choice("a1 '\n.sTÉ½²") for _ in range(rng.randint(1, 24))))
    # strings that differed before: newly assigned letters beside letters, numbers and marks
    texts += ["".join(map(chr, x)) for x in ((0x3F124, 0xB235), (0x31, 0x31, 0x3F124), (0x2E600, 0x31114, 0x27, 0x533C3), (0x3C85B, 0x54, 0x9A61), (0x329C3, 0x27, 0x73, 0x73), (0x11DE0, 0x31), (0x20, 0x32D8E, 0x820DC))]
    want = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(BYTE_BPE), special_tokens={})
    done = byte_bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTE_BPE, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(done) == len(texts)
    for r in done:
        text = texts[r["doc_id"]]
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.encode_ordinary(text), ascii(text)
        assert bytes(r["decoded"]).decode() == text
