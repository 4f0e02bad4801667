"""Token-id output as length-delimited, checksummed binary records with an offset index.

Record format (the public TFRecord framing)::

    u64 length | u32 masked crc32c(length) | payload | u32 masked crc32c(payload)

Payload: ``i64 doc_id | u8 flags | u8 width | ids``; flag bit 0 says that doc_id is
null, width is 2 or 4 bytes an id, little-endian.  Beside each shard stands an index of
fixed-size entries (offset, payload length, doc id, null flag, number of ids), so that
records can be read in any order (``read_at``) without scanning the shard.

Edge cases: a null or empty text gives the end id alone; rows with a null doc_id come
first; repeated doc_ids keep one record a row; an empty table gives no shards.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import WordCache, by_group, filesystem, fresh_path, pick, slices, tidy, tuned, written

HEADER = struct.Struct("<qBB")
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("null", "u1"), ("n_ids", "<u8")])
MANIFEST = "part long, shard string, index string, n_docs long, n_tokens long, n_bytes long"

#: Reversed polynomial of CRC-32C and the constant that masks it (fixed values of the format).
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8
BLOCK = 64


def _tables() -> np.ndarray:
    """tables[k][b]: the checksum of byte b followed by k zero bytes."""
    first = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ POLYNOMIAL, first >> 1)
    rows = [first]
    for _ in range(7):
        rows.append(first[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.stack(rows)


_T = _tables()


class _Shift:
    """Moves a checksum state over 2**k zero bytes, for any k, by four table lookups."""

    def __init__(self) -> None:
        bits = np.uint64(1) << np.arange(32, dtype=np.uint64)
        self.powers = [self._bytewise(_T[0][bits & 255] ^ (bits >> 8))]

    @staticmethod
    def _bytewise(columns: np.ndarray) -> np.ndarray:
        out = np.zeros((4, 256), np.uint64)
        for byte in range(4):
            for bit in range(8):
                out[byte, (np.arange(256) >> bit) & 1 == 1] ^= columns[8 * byte + bit]
        return out

    def apply(self, k: int, state: np.ndarray) -> np.ndarray:
        while len(self.powers) <= k:
            last = len(self.powers) - 1
            self.powers.append(self._bytewise(self.apply(last, self.apply(last, np.uint64(1) << np.arange(32, dtype=np.uint64)))))
        t = self.powers[k]
        return t[0][state & 255] ^ t[1][(state >> 8) & 255] ^ t[2][(state >> 16) & 255] ^ t[3][(state >> 24) & 255]

    def over(self, n: np.ndarray, state: np.ndarray, unit: int = 0) -> np.ndarray:
        """Each state over n * 2**unit zero bytes."""
        state = state.copy()
        for k in range(int(n.max(initial=0)).bit_length()):
            on = (n >> k) & 1 == 1
            state[on] = self.apply(k + unit, state[on])
        return state


_SHIFT = _Shift()


def crc32c(buffers: list[bytes]) -> np.ndarray:
    """CRC-32C of every buffer.

    All buffers are cut into blocks, whose checksums are computed side by side; a
    checksum is linear, so the blocks of a buffer combine after a shift by the bytes
    that follow them.  Zero bytes in front of a buffer do not change it.
    """
    lengths = np.fromiter(map(len, buffers), np.int64, len(buffers))
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    data = np.zeros(total * BLOCK, np.uint8)
    ends = np.cumsum(blocks) * BLOCK
    for buffer, end, length in zip(buffers, ends.tolist(), lengths.tolist()):
        data[end - length : end] = np.frombuffer(buffer, np.uint8)
    words = data.view("<u8").reshape(total, BLOCK // 8)
    state = np.zeros(total, np.uint64)
    for k in range(BLOCK // 8):
        x = words[:, k] ^ state
        state = _T[7][x & 255]
        for byte in range(1, 8):
            state ^= _T[7 - byte][(x >> (8 * byte)) & 255]
    after = np.repeat(np.cumsum(blocks), blocks) - np.arange(total) - 1
    state = _SHIFT.over(after, state, unit=6)
    joined = np.zeros(len(buffers), np.uint64)
    full = blocks > 0
    if total:
        joined[full] = np.bitwise_xor.reduceat(state, (np.cumsum(blocks) - blocks)[full])
    ones = np.full(len(buffers), 0xFFFFFFFF, np.uint64)
    return joined ^ _SHIFT.over(lengths, ones) ^ np.uint64(0xFFFFFFFF)


def masked(crcs: np.ndarray) -> np.ndarray:
    """The stored form of checksums: rotated, then moved by a constant."""
    return (((crcs >> 15) | (crcs << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payloads: list[bytes]) -> list[bytes]:
    """Each payload as a framed record."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    sums = masked(crc32c(heads + payloads)).tolist()
    n = len(payloads)
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b))) for h, p, a, b in zip(heads, payloads, sums[:n], sums[n:])]


def unframe(stream) -> Iterator[bytes]:
    """The payloads of a shard in order; raises ValueError on a wrong checksum or a cut record."""
    held: list[tuple[bytes, int, bytes, int]] = []
    size = 0

    def checked():
        n = len(held)
        sums = masked(crc32c([h[0] for h in held] + [h[2] for h in held])).tolist()
        for i, (_, a, payload, b) in enumerate(held):
            if (sums[i], sums[n + i]) != (a, b):
                raise ValueError("a record's checksum is wrong")
            yield payload

    while head := stream.read(12):
        if len(head) < 12:
            raise ValueError("a record's header is cut")
        length, a = struct.unpack("<QI", head)
        body = stream.read(length + 4)
        if len(body) < length + 4:
            raise ValueError("a record is cut")
        held.append((head[:8], a, body[:length], struct.unpack("<I", body[length:])[0]))
        size += length
        if size > 4_000_000:
            yield from checked()
            held, size = [], 0
    if held:
        yield from checked()


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One document's payload; two bytes an id where all of them fit."""
    width = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return HEADER.pack(doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = HEADER.unpack_from(payload)
    return (None if null else doc_id), np.frombuffer(payload, f"<u{width}", offset=HEADER.size)


def read_at(shard: str, index: str, k: int) -> tuple[int | None, np.ndarray]:
    """The k-th record of a shard through its index, without reading the others."""
    store, path = filesystem(index)
    with store.open_input_file(path) as f:
        f.seek(k * INDEX.itemsize)
        at = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
    store, path = filesystem(shard)
    with store.open_input_file(path) as f:
        f.seek(int(at["offset"]))
        return unpack(next(unframe(_Part(f.read(int(at["length"]) + 16)))))


class _Part:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def read(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]


_ENCODERS: dict[tuple[str, bool], WordCache] = {}

#: Letters, punctuation after them and what else a chunk holds.  The first two are a
#: pre-token each, for such characters as these.
_PARTS = re.compile(r"([^\W\d_]*)([.,:;!?|&%$#*]*)(.*)\n")
_JOINED = 500


class _Chunks:
    """Ids of white-space-free chunks by the tokenizers library.

    Chunks of letters with or without trailing punctuation are one or two pre-tokens.  These
    pieces stand in very many chunks, so their ids are kept in a cache of their own, under
    the lower-case form of ASCII letters, which the tokenizer takes anyway; new ones stand
    between spaces and are encoded many to a call.  Since they are normalised already but for
    their case, a lighter form of the tokenizer does it, with the same model.  The vocabulary
    marks the token that ends a pre-token, so the ids split again there.  Where the marks do
    not match the pieces, and for all other chunks, each chunk has an encoding of its own.

    With ``added``, the tokenizer's special tokens have their own ids where they stand in a
    text, as is the library's default; else they are text like any other.
    """

    def __init__(self, path: str, added: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.light = Tokenizer.from_file(path)
        self.light.encode_special_tokens = True
        self.light.normalizer = normalizers.Lowercase()
        self.light.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.pieces = WordCache(self._make_pieces, "uint32", limit=500_000)

    def _encode(self, words: list[str], light: bool = False) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in (self.light if light else self.tokenizer).encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def _make_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens; none for those whose marks do not match."""
        found = []
        for i in range(0, len(pieces), _JOINED):
            some = pieces[i : i + _JOINED]
            ids, _ = self._encode([" ".join(some)], light=True)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                found.append((ids, np.diff(cuts, prepend=0)))
            else:
                found.append((ids[:0], np.zeros(len(some), np.int64)))
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

    def make(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, n_pieces = [], []
        for word, tail, rest in _PARTS.findall("\n".join(chunks) + "\n"):
            if rest or not _plain(word):
                n_pieces.append(0)
                continue
            pieces.append(word.lower() if word.isascii() else word)
            if tail:
                pieces.append(tail)
            n_pieces.append(2 if tail else 1)
        counts = np.array(n_pieces)
        ids, sizes = self.pieces.take(self.pieces.codes(pieces))
        whole = (counts > 0) & (by_group(sizes == 0, counts) == 0)
        kept = np.repeat(whole, counts)
        alone = np.flatnonzero(~whole)
        others, lengths_alone = self._encode([chunks[i] for i in alone.tolist()])
        lengths = by_group(np.where(kept, sizes, 0), counts)
        lengths[alone] = lengths_alone
        from_pieces = np.repeat(whole, lengths)
        out = np.empty(int(lengths.sum()), np.uint32)
        out[from_pieces], out[~from_pieces] = ids[np.repeat(kept, sizes)], others
        return out, lengths


def _plain(word: str) -> bool:
    """Letters alone, before and after the tokenizer's normalisation."""
    return word.isalpha() and (word.isascii() or word.lower().isalpha() and unicodedata.is_normalized("NFC", word))


def encoder(path: str, added: bool = False) -> WordCache:
    """A bounded cache of chunks' ids for a tokenizer file; a worker keeps it between tasks."""
    if (path, added) not in _ENCODERS:
        _ENCODERS[path, added] = WordCache(_Chunks(path, added).make, "uint32", limit=900_000)
    return _ENCODERS[path, added]


def encode_texts(texts: list[str], tokenizer_path: str, added: bool = False) -> list[np.ndarray]:
    """Ids of whole texts for a tokenizer whose pre-tokens and special tokens never span white space."""
    if not texts:
        return []
    cache = encoder(tokenizer_path, added)
    # the tokenizer never joins characters across white space; a text's words are numbered natively, so that each is looked up once
    chunks = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    words = chunks.flatten().dictionary_encode()
    ids, lengths = cache.take(cache.codes(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()])
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(pc.list_value_length(chunks).to_numpy())]
    return np.split(ids, ends[:-1])


def write_records(df: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Writes every text's ids in ascending id order; returns the manifest, one row a shard.

    Rows are dealt by ranges of the id, so shards in ``part`` order hold ascending ids.
    A task writes under a name of its own and reports it at its end: files of failed or
    repeated attempts are never in the manifest.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "token-records")
    store, local = filesystem(path)
    store.create_dir(local)
    rows = pick(df, doc_id=id_col, text=text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        shard, index = f"{path}/{part:06d}-{name}.tfrecord", f"{path}/{part:06d}-{name}.idx"
        store, local = filesystem(shard)
        out, entries, offset, tokens = None, [], 0, 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                out = out or store.open_output_stream(local, compression=None)
                encoded = [np.append(x, np.uint32(end_id)) for x in encode_texts(texts[a:b], tokenizer_path, added=True)]
                payloads = [pack(i, x) for i, x in zip(ids[a:b], encoded)]
                for i, x, payload, record in zip(ids[a:b], encoded, payloads, frame(payloads)):
                    entries.append((offset, len(payload), i or 0, i is None, len(x)))
                    offset, tokens = offset + len(record), tokens + len(x)
                    out.write(record)
        if out is None:
            return
        out.close()
        store, local = filesystem(index)
        with store.open_output_stream(local, compression=None) as f:
            f.write(np.array(entries, INDEX).tobytes())
        yield pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "index": index, "n_docs": len(entries), "n_tokens": tokens, "n_bytes": offset}], ARROW_MANIFEST)

    return written(rows.mapInArrow(tidy(write), MANIFEST), "token-manifest")


ARROW_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.string()), ("index", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def read_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents read back from the shards: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids.

    start counts the ids of all records before it.  The manifest has one row a shard, so
    its running total is small; every shard is one task.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    based = based.select("shard", "base").repartition(max(1, manifest.count()), "shard")
    schema = ARROW_RECORDS if with_ids else pa.schema(list(ARROW_RECORDS)[:-1])

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, local = filesystem(row["shard"])
                start, rows, held = row["base"], [], 0
                with store.open_input_stream(local, compression=None, buffer_size=1 << 20) as f:
                    for payload in unframe(f):
                        doc_id, ids = unpack(payload)
                        data = ids.astype("<u4").tobytes()
                        rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(data)} | ({"ids": data} if with_ids else {}))
                        start, held = start + len(ids), held + len(data)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return based.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


ARROW_RECORDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_records(manifest, with_ids=False)
