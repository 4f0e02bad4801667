"""Byte-level BPE by a global shuffle of distinct words.

1. ``pre_tokenise`` explodes every text into pre-tokens with positions, per block of
   documents: each distinct pre-token of a block gets a number, and each document is the
   sequence of their numbers.  The sequences go to a file a block in the shared folder.
2. The blocks' distinct pre-tokens are shuffled by a hash of the word, packed per hash
   bucket; there each distinct word of the corpus is encoded exactly once.
3. The ids are joined back by block and bucket, and put into each document's sequence by
   position.

Decoding joins ids to the token-byte table (a table of the vocabulary's fixed size).

A word, however frequent, meets at most one entry a block, so no word is a hot key.
Blocks are bounded by characters, so no task holds more than a block (or one text).

Hash buckets and tasks are counted from the bytes of text, so what one holds does not grow
with the table.

tiktoken's and Python's pattern libraries know different versions of Unicode.  Characters
that the pattern's classes see differently are replaced by stand-ins while a text is cut,
so every text is cut as tiktoken cuts it.

Edge cases: null and empty texts have no ids and decode to no bytes; repeated or null
doc_ids keep one result a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, fresh_path, n_buckets, n_tasks, pick, ragged_take, text_bytes, tidy, tidy_group, tuned, written
from millrace.llm.packing import expand, pack, read_sections, squeeze, unpack, write_sections

BLOCK_CHARS = 6_000_000
WORDS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("words", pa.binary())])
IDS = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.binary())])


def pack_words(words: list[bytes]) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)), zstandard.compress(b"".join(words), 1))


def unpack_words(data: bytes) -> list[bytes]:
    lengths, body = unpack(data)
    body, ends = zstandard.decompress(body), np.cumsum(lengths, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a vocabulary file: base64 token and rank a line."""
    store, local = filesystem(path)
    with store.open_input_stream(local, compression=None) as f:
        pairs = (line.split() for line in f.read().splitlines() if line)
        return {base64.b64decode(a): int(b) for a, b in pairs}


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("millrace", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def _classes(pattern: str) -> list[str]:
    """The character classes that a pattern names."""
    return sorted(set(re.findall(r"\\p\{\w+\}|\\[sSdDwW]", pattern)))


@lru_cache(maxsize=4)
def stand_ins(pattern: str) -> dict[int, str]:
    """Code points that tiktoken puts in other classes of the pattern than Python does, each with a
    character that Python puts where tiktoken puts the code point."""
    import regex
    import tiktoken

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    plain = {bytes([i]): i for i in range(256)}
    there, here = np.zeros(0x110000, np.int64), np.zeros(0x110000, np.int64)
    for i, kind in enumerate(_classes(pattern)):
        found = bytes(tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=plain, special_tokens={}).encode_ordinary(every))
        for seen, text in ((there, found.decode()), (here, "".join(regex.findall(kind, every)))):
            seen[np.frombuffer(text.encode("utf-32-le"), "<u4")] |= 1 << i
    usual = points[(points > 127) & (there[points] == here[points])]
    first = {int(kind): chr(usual[at]) for kind, at in zip(*np.unique(here[usual], return_index=True))}
    return {int(c): first[int(there[c])] for c in points[there[points] != here[points]].tolist() if int(there[c]) in first}


def splitter(pattern: str, others: dict[int, str]):
    """A function from a text to its pre-tokens, which together are the text."""
    import regex

    find = regex.compile(pattern)
    points = sorted(others)
    starts = [c for c in points if c - 1 not in others]
    ends = [c for c in points if c + 1 not in others]
    odd = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends)) + "]") if points else None

    def split(text: str) -> list[str]:
        if odd is None or text.isascii() or not odd.search(text):
            return find.findall(text)
        return [text[m.start() : m.end()] for m in find.finditer(text.translate(others))]

    return split


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: start and length in the joined bytes of all tokens."""
    table = ranks(path)
    lengths = np.zeros(max(table.values(), default=-1) + 1, np.int64)
    ordered = [b""] * len(lengths)
    for token, rank in table.items():
        lengths[rank], ordered[rank] = len(token), token
    return np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(ordered), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of a sequence of ids, by the token-byte table."""
    starts, lengths, flat = token_bytes(path)
    return flat[ragged_take(starts[ids], lengths[ids])].tobytes()


class Block:
    """Documents whose pre-tokens are numbered together."""

    def __init__(self, number_in_task: int = 0) -> None:
        self.number_in_task = number_in_task
        self.number: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.codes: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, pieces: list[str], chars: int) -> None:
        number = self.number
        for w in set(pieces).difference(number):
            number[w] = len(number)
        self.codes.append(np.fromiter(map(number.__getitem__, pieces), np.uint32, len(pieces)))
        self.doc_ids.append(doc_id)
        self.chars += chars

    def write(self, path: str, buckets: int) -> pa.RecordBatch:
        """Writes the sequences to a file; returns the distinct words as a row a bucket."""
        words = [w.encode() for w in self.number]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        sections = [
            squeeze(order),
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array([d is None for d in self.doc_ids], np.uint8).tobytes(),
            squeeze(np.fromiter(map(len, self.codes), np.uint32, len(self.codes))),
            squeeze(np.concatenate(self.codes)),
        ]
        name = write_sections(path, sections, "codes", self.number_in_task)
        cuts = np.concatenate([np.searchsorted(bucket[order], np.arange(buckets)), [len(order)]]).tolist()
        rows = [(k, [words[i] for i in order[a:b].tolist()]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        rows = rows or [(0, [])]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array([k for k, _ in rows], pa.int32()), pa.array([pack_words(w) for _, w in rows], pa.binary())], schema=WORDS)


def read_block(name: str) -> tuple[np.ndarray, list[int | None], np.ndarray, np.ndarray]:
    """Word order, doc ids, pre-tokens a document and the numbers of a written block."""
    a, b, c, d, e = read_sections(name)
    doc_ids = [None if null else i for i, null in zip(np.frombuffer(b, "<i8").tolist(), c)]
    return expand(a), doc_ids, expand(d), expand(e)


def pre_tokenise(df: DataFrame, pattern: str, buckets: int, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, bucket, words): the distinct pre-tokens of every block by hash bucket, as a written table."""
    path = fresh_path(df.sparkSession, "bpe-blocks")
    store, local = filesystem(path)
    store.create_dir(local)

    def run(batches):
        split, block = splitter(pattern, others), Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if block.chars and block.chars + len(text) > block_chars:
                    yield block.write(path, buckets)
                    block = Block(block.number_in_task + 1)
                block.add(doc_id, split(text), len(text))
        if block.doc_ids:
            yield block.write(path, buckets)

    rows = pick(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    others = stand_ins(pattern)
    return written(rows.mapInArrow(tidy(run), "block string, bucket int, words binary"), "bpe-words")


def encode_words(words: DataFrame, path: str, pattern: str, tasks: int | None = None) -> DataFrame:
    """(block, bucket, ids): within a bucket each distinct word is encoded once, for all blocks."""

    def run(table: pa.Table) -> pa.Table:
        piece, known = encoding(path, pattern)._core_bpe.encode_single_piece, {}
        out = []
        for data in table.column("words").to_pylist():
            ids = []
            for w in unpack_words(data):
                if w not in known:
                    known[w] = piece(w)
                ids.append(known[w])
            flat = np.fromiter((i for x in ids for i in x), np.uint32)
            out.append(pack(np.fromiter(map(len, ids), np.uint32, len(ids)), squeeze(flat)))
        return pa.Table.from_arrays([table.column("block"), table.column("bucket"), pa.array(out, pa.binary())], schema=IDS)

    dealt = words if tasks is None else words.repartitionById(tasks, F.col("bucket"))  # buckets go round the tasks
    return dealt.groupBy("bucket").applyInArrow(tidy_group(run), "block string, bucket int, ids binary")


def reassemble(ids: DataFrame, decode_path: str | None = None, tasks: int | None = None) -> DataFrame:
    """(doc_id, ids) of every document: its block's sequence with the words' ids put in.

    With the path of a vocabulary also what the ids decode to, by its token-byte table.
    """

    def run(table: pa.Table) -> pa.Table:
        order, doc_ids, counts, numbers = read_block(table.column("block")[0].as_py())
        parts = [unpack(x) for x in table.sort_by("bucket").column("ids").to_pylist()]
        lengths = np.concatenate([x for x, _ in parts]).astype(np.int64)
        flat = np.concatenate([expand(x) for _, x in parts])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        starts, lengths = (np.cumsum(lengths) - lengths)[place], lengths[place]
        out, ends = [], np.cumsum(counts, dtype=np.int64).tolist()
        for a, b in zip([0, *ends], ends):
            c = numbers[a:b]
            out.append(flat[ragged_take(starts[c], lengths[c])].astype("<u4").tobytes())
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(out, pa.binary())}
        if decode_path:
            columns["decoded"] = pa.array([decode_ids(np.frombuffer(x, "<u4"), decode_path) for x in out], pa.binary())
        return pa.table(columns)

    dealt = ids if tasks is None else ids.repartition(tasks, "block")
    return dealt.groupBy("block").applyInArrow(tidy_group(run), "doc_id long, ids binary" + (", decoded binary" if decode_path else ""))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for every row, ids as little-endian unsigned 32-bit integers.

    With ``decoded`` also the bytes that the ids decode to, so that decoding needs no
    second pass of them through a worker.
    """
    size = text_bytes(df, text_col)
    tasks = n_tasks(df.sparkSession, size)
    words = pre_tokenise(df, pattern, n_buckets(size), id_col, text_col)
    return reassemble(encode_words(words, path, pattern, tasks), path if decoded else None, tasks)


def decode(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The bytes (decoded) of a column of ids, beside the kept columns and the ids."""
    source = pick(df, **{k: k for k in keep}, ids=ids_col)
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches):
        for batch in batches:
            out = [None if x is None else decode_ids(np.frombuffer(x, "<u4"), path) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*keep, "ids", "decoded"])

    return source.mapInArrow(tidy(run), f"{kept}, ids binary, decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    done = encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return done.select(
        "doc_id",
        F.floor(F.length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
