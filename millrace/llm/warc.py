"""WARC archives: write, normalise monolithic gzip, index, read back.

``write_warc`` writes one record a page into archives that are single gzip streams.
``normalise`` inflates such a file once, as a stream, rewrites every record as a gzip
member of its own and writes a sidecar index (offset, compressed length, record type,
record id).  ``read_warc`` reads normalised archives through their indexes.

Records whose payload was seen in another record are ``revisit`` records: of equal
payloads the one with the largest page_id holds the payload, the others refer to it.

Edge cases: null html is an empty payload; null urls give no target header; an empty
table gives no archives; archives may be cut anywhere between records, but a cut or
foreign record raises ValueError.  A row with a null page_id is a response of its own;
rows with the same page_id keep a record each.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import filesystem, fresh_path, pick, tidy, tuned, written

LEVEL = 1
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("revisit", "u1"), ("null", "u1"), ("page_id", "<i8")])
ID = "urn:millrace:page:%s"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Dates are those of the crawl, which the pages table does not hold.
DATE = "1970-01-01T00:00:00Z"
_READ = 1 << 20


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC payload digests are written."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record.  A revisit keeps the HTTP head, whose Content-Length is that of the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID % page_id}>", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID % refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Inflate(io.RawIOBase):
    """The inflated bytes of a gzip stream, of one member or several, in bounded memory."""

    def __init__(self, stream):
        self.stream, self.z, self.rest = stream, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        while True:
            data = self.rest or self.stream.read(_READ)
            if not data:
                if not self.z.eof:
                    raise ValueError("the gzip stream is cut")
                return 0
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, len(out))
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                out[: len(got)] = got
                return len(got)


def records(stream):
    """(headers, block, raw bytes) of every record of an inflated stream."""
    while line := stream.readline():
        raw = [line]
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            raw.append(line)
            key, _, value = line.decode().partition(":")
            headers[key.strip().lower()] = value.strip()
        raw.append(line)
        length = int(headers["content-length"])
        body = stream.read(length + 4)
        if len(body) < length + 4 or body[length:] != b"\r\n\r\n":
            raise ValueError("a record is cut")
        yield headers, body[:length], b"".join(raw) + body


def _page(uri: str) -> int | None:
    name = uri.strip("<>").rpartition(":")[2]
    return None if name == "None" else int(name)


def normalise(source: str, target: str, index: str) -> int:
    """Rewrites an archive with a gzip member a record, and its index; returns the number of records."""
    (a, ap), (b, bp), (c, cp) = filesystem(source), filesystem(target), filesystem(index)
    entries, offset = [], 0
    with a.open_input_stream(ap, compression=None) as f, b.open_output_stream(bp, compression=None) as out:
        for headers, _, raw in records(io.BufferedReader(_Inflate(f), _READ)):
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            member = z.compress(raw) + z.flush()
            out.write(member)
            page = _page(headers["warc-record-id"])
            entries.append((offset, len(member), headers["warc-type"] == "revisit", page is None, page or 0))
            offset += len(member)
    with c.open_output_stream(cp, compression=None) as f:
        f.write(np.array(entries, INDEX).tobytes())
    return len(entries)


def read_member(data: bytes) -> dict:
    """What one member's record says of its page, with the payload where it holds it."""
    headers, block, _ = next(records(io.BytesIO(zlib.decompress(data, 31))))
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0])
    kind = headers["warc-type"]
    if kind == "response" and (len(payload) != length or "sha1:" + digest(payload) != headers["warc-payload-digest"]):
        raise ValueError("a payload does not match its record")
    return {
        "page_id": _page(headers["warc-record-id"]), "payload_bytes": length, "payload_digest": headers["warc-payload-digest"].removeprefix("sha1:"), "record_type": kind,
        "refers_to": _page(headers["warc-refers-to"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None,
    }


MANIFEST = "archive string"
ARCHIVES = "archive string, index string, n_records long"
READ_BACK = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def write_warc(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", dedup: bool = True, path: str | None = None) -> DataFrame:
    """Writes monolithic archives, one a task; returns their paths (archive).

    The first record of a digest is found by an aggregation with partial sums, so a
    digest that many pages share is no hot group; pages then join it by their page_id and
    digest, and payloads are shuffled once.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, "warc")
    pages = pick(df, page_id=id_col, url=url_col, html=html_col)
    if dedup:
        pages = pages.withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
        seen = pages.select("page_id", "sha1")
        first = seen.groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
        revisits = seen.join(first, "sha1").where("page_id <> first").distinct()
        pages = pages.join(revisits, ["page_id", "sha1"], "left")
    else:
        pages = pages.withColumn("first", F.lit(None).cast("long"))

    def write(batches):
        out = None
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    archive = f"{path}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    store, local = filesystem(archive)
                    store.create_dir(local.rpartition("/")[0])
                    out, z = store.open_output_stream(local, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                payload = (html or "").encode()
                out.write(z.compress(record(page_id, url, payload, digest(payload), first)))
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [archive]})

    return written(pages.select("page_id", "url", "html", "first").mapInArrow(tidy(write), MANIFEST), "warc-manifest")


def normalise_all(archives: DataFrame) -> DataFrame:
    """Normalises every archive, one a task; returns archive, index and n_records."""

    def run(batches):
        for batch in batches:
            for source in batch.column(0).to_pylist():
                stem = source.removesuffix(".warc.gz") + "-" + uuid.uuid4().hex
                n = normalise(source, f"{stem}.members.warc.gz", f"{stem}.idx")
                yield pa.RecordBatch.from_pydict({"archive": [f"{stem}.members.warc.gz"], "index": [f"{stem}.idx"], "n_records": [n]})

    spread = archives.select("archive").repartition(max(1, archives.count()), "archive")
    return written(spread.mapInArrow(tidy(run), ARCHIVES), "warc-archives")


def read_warc(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of normalised archives, found through their indexes."""
    schema = READ_BACK.append(pa.field("payload", pa.binary())) if payloads else READ_BACK

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, local = filesystem(row["index"])
                with store.open_input_stream(local, compression=None) as f:
                    entries = np.frombuffer(f.read(), INDEX)
                store, local = filesystem(row["archive"])
                with store.open_input_stream(local, compression=None, buffer_size=_READ) as f:
                    rows, held = [], 0
                    for length in entries["length"].tolist():
                        rows.append(read_member(f.read(length)))
                        held += length
                        if held > 4_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    spread = archives.select("archive", "index").repartition(max(1, archives.count()), "archive")
    return spread.mapInArrow(tidy(run), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else ""))


def read_one(archive: str, index: str, page_id: int) -> dict | None:
    """One page's record, by its index entry and without reading the others."""
    store, local = filesystem(index)
    with store.open_input_stream(local, compression=None) as f:
        entries = np.frombuffer(f.read(), INDEX)
    for k in np.flatnonzero((entries["page_id"] == page_id) & (entries["null"] == 0))[:1]:
        store, local = filesystem(archive)
        with store.open_input_file(local) as f:
            f.seek(int(entries["offset"][k]))
            return read_member(f.read(int(entries["length"][k])))
    return None


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tuned(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return read_warc(normalise_all(write_warc(pages)))
