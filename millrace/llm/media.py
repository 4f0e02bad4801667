"""ISO media container columns: write frames losslessly, then read codec, duration and
keyframe byte ranges from the nested boxes alone.

``encode_media`` stores a binary payload as 8-bit grey 8x8 frames (64 bytes each) of an
uncompressed video track.  ``media_features`` walks the boxes of any such file, decodes
its sample tables (stts, stsc, stsz, stco/co64, stss) and returns what they say; sample
bytes are only located, never decoded.

Edge cases: a null or empty text is one frame of zeros; a null container or one without
a readable movie box gives null features, and so do boxes, tables, offsets or sync samples
that say more than the file holds; memory is bounded by the file's own size; equal texts give equal containers (no clocks
or random values are stored); long payloads get 64-bit sizes and offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import pick, tidy, tuned

FRAME_SIDE = 8
FRAME_BYTES = FRAME_SIDE * FRAME_SIDE
TIMESCALE = 25
#: Frames a chunk, and a sync sample is listed at the start of each group of pictures.
FRAMES_PER_CHUNK = 512
GOP = 32
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: Identity transform of the movie and track headers (a fixed value of the format).
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(parts)


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of a frame."""
    return data + bytes(-len(data) % FRAME_BYTES if data else FRAME_BYTES)


def encode_container(payload: bytes) -> bytes:
    """A movie whose only track holds the payload's frames; the length must be whole frames."""
    frames = len(payload) // FRAME_BYTES
    if not frames or len(payload) % FRAME_BYTES:
        raise ValueError("the payload must be a positive number of whole frames")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    mdat = _box(b"mdat", payload)
    first = len(ftyp) + len(mdat) - len(payload)
    starts = np.arange(0, frames, FRAMES_PER_CHUNK, dtype=np.int64) * FRAME_BYTES + first
    wide = int(starts[-1]) >= 1 << 32
    offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", len(starts)), starts.astype(">u8" if wide else ">u4").tobytes())
    last = frames % FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if frames >= FRAMES_PER_CHUNK else []
    runs += [(len(starts), last, 1)] if last else []
    sync = np.arange(1, frames + 1, GOP, dtype=">u4")
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", FRAME_SIDE, FRAME_SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8 | 32, -1))
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME_BYTES, frames)),
        offsets,
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, frames, 0x55C4, 0)), _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"frames\0"), minf)
    side = struct.pack(">II", FRAME_SIDE << 16, FRAME_SIDE << 16)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX, side, flags=3)
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return ftyp + mdat + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


@dataclass
class Track:
    """What a track's boxes say.  Tables are as long as their boxes; counts that say more are rejected."""

    handler: str = ""
    codec: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    times: np.ndarray | None = None
    runs: np.ndarray | None = None
    n_samples: int = 0
    #: The size of all samples, or 0 where ``sizes`` lists them.
    size: int = 0
    sizes: np.ndarray | None = None
    chunks: np.ndarray | None = None
    sync: np.ndarray | None = None

    def _before(self, samples: np.ndarray) -> np.ndarray:
        """Bytes of all samples before the given ones (numbers from 0)."""
        if self.size:
            return samples * self.size
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.sizes)])[samples]

    def _heads(self) -> np.ndarray:
        """The first sample of every chunk, and where the last one ends, by the chunk runs."""
        first = self.runs[:, 0]
        if len(first) and (first[0] != 1 or (np.diff(first) < 1).any()):
            raise ValueError("chunk runs must rise from the first chunk")
        per = np.zeros(len(self.chunks), np.int64)
        for i, (start, count) in enumerate(self.runs[first <= len(per)].tolist()):
            until = int(first[i + 1]) - 1 if i + 1 < len(first) else len(per)
            per[start - 1 : until] = count
        heads = np.concatenate([np.zeros(1, np.int64), np.cumsum(per)])
        if heads[-1] < self.n_samples:
            raise ValueError("the chunk table holds too few samples")
        return np.minimum(heads, self.n_samples)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and size of what every chunk holds, from the chunk and size tables."""
        if self.chunks is None or self.runs is None or not self.n_samples:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = self._before(self._heads())
        return self.chunks, np.diff(held)

    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte offset and size of every sync sample.  Where no table lists them all samples are: then those of chunks, each
        a run of keyframes."""
        offsets, sizes = self.ranges()
        if self.sync is None or not len(offsets):
            return offsets[sizes > 0], sizes[sizes > 0]
        sync, heads = self.sync - 1, self._heads()
        if len(sync) and (sync.min() < 0 or sync.max() >= self.n_samples):
            raise ValueError("a sync sample that there is not")
        chunk = np.searchsorted(heads, sync, "right") - 1
        start = self._before(sync)
        return offsets[chunk] + start - self._before(heads[chunk]), self._before(sync + 1) - start


#: Boxes inside boxes beyond which a file is taken as broken.
DEEPEST = 32


def _walk(data: memoryview, start: int, end: int):
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("a box is longer than what holds it")
        yield kind, start + head, start + size
        start += size


def parse_container(data: bytes, most: int | None = None) -> list[Track]:
    """The tracks of a container, or the first ``most``.  Media data boxes are stepped over."""
    view, tracks = memoryview(data), []

    def table(a: int, b: int, dtype: str, count: int) -> np.ndarray:
        if a + count * int(dtype[2:]) > b:
            raise ValueError("a table is longer than its box")
        return np.frombuffer(view, dtype, count, a).astype(np.int64)

    def number(a: int) -> int:
        return struct.unpack_from(">I", view, a)[0]

    work = [_walk(view, 0, len(view))]
    while work:
        found = next(work[-1], None)
        if found is None:
            work.pop()
            continue
        kind, a, b = found
        if kind == b"trak":
            if len(tracks) == most:
                break
            tracks.append(Track())
        if kind in CONTAINERS:
            if len(work) == DEEPEST:
                raise ValueError("boxes are nested too deep")
            work.append(_walk(view, a, b))
            continue
        if not tracks:
            continue
        t = tracks[-1]
        if kind == b"mdhd":
            form, at = (">IQ", a + 20) if view[a] else (">II", a + 12)
            t.timescale, t.duration = struct.unpack_from(form, view, at)
        elif kind == b"hdlr":
            t.handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and number(a + 4):
            t.codec = bytes(view[a + 12 : a + 16]).decode("latin-1").strip()
            if t.handler == "vide":
                t.width, t.height = struct.unpack_from(">HH", view, a + 8 + 32)
        elif kind == b"stts":
            t.times = table(a + 8, b, ">u4", 2 * number(a + 4)).reshape(-1, 2)
        elif kind == b"stsc":
            t.runs = table(a + 8, b, ">u4", 3 * number(a + 4)).reshape(-1, 3)[:, :2]
        elif kind == b"stsz":
            t.size, t.n_samples = struct.unpack_from(">II", view, a + 4)
            t.sizes = None if t.size else table(a + 12, b, ">u4", t.n_samples)
        elif kind in (b"stco", b"co64"):
            t.chunks = table(a + 8, b, ">u4" if kind == b"stco" else ">u8", number(a + 4))
        elif kind == b"stss":
            t.sync = table(a + 8, b, ">u4", number(a + 4))
    return tracks


def describe(data: bytes | None) -> dict | None:
    """codec, size, duration and keyframe ranges of the first track; None if it can't be read."""
    try:
        tracks = parse_container(data, 1) if data is not None else []
        if not tracks:
            return None
        track = tracks[0]
        if track.n_samples and (track.size * track.n_samples if track.size else int(track.sizes.sum())) > len(data):
            return None
        offsets, sizes = track.ranges()
        keys, key_sizes = track.keyframes()
        if len(offsets) and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(data)):
            return None
        duration = 1000 * track.duration // track.timescale if track.timescale else 0
        if duration >= 1 << 63:
            return None
        return {
            "codec": track.codec, "width": track.width, "height": track.height, "n_samples": track.n_samples, "duration_ms": duration,
            "key_offsets": keys, "key_sizes": key_sizes, "offsets": offsets, "sizes": sizes,
        }
    except (ValueError, struct.error, IndexError):
        return None


def stored_samples(data: bytes, found: dict) -> bytes:
    """The bytes of all samples, in order, by the ranges of chunks that were read."""
    offsets, sizes = found["offsets"], found["sizes"]
    if not len(offsets):
        return b""
    ends = offsets + sizes
    cuts = np.flatnonzero(offsets[1:] != ends[:-1])
    firsts, lasts = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(offsets) - 1]])
    return b"".join(data[a:b] for a, b in zip(offsets[firsts].tolist(), ends[lasts].tolist()))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the container (media) of every text's UTF-8 bytes."""

    def encode(batches):
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            media = [encode_container(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(tidy(encode), f"doc_id {kind}, n_bytes long, media binary")


FEATURES = "codec string, width int, height int, n_samples long, duration_ms long, key_offsets array<long>, key_sizes array<long>"
DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _feature(found: dict) -> str:
    keys = ";".join(f"{o}+{s}" for o, s in zip(found["key_offsets"].tolist(), found["key_sizes"].tolist()))
    return f"{found['codec']} {found['width']}x{found['height']} samples={found['n_samples']} ms={found['duration_ms']} keys={keys}"


def media_features(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Features of a column of containers beside the kept columns.

    With ``digests`` it returns digests of the stored samples and of the container, and
    the features as one string, in place of the feature columns.
    """
    source = pick(df, **{k: k for k in keep}, _media=media_col)
    kept = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep)
    names = [x.split()[0] for x in (DIGESTS if digests else FEATURES).split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for data in batch.column(batch.num_columns - 1).to_pylist():
                found = describe(data)
                if found is None:
                    rows.append(dict.fromkeys(names))
                elif digests:
                    stored = stored_samples(data, found)
                    rows.append({
                        "payload_bytes": len(stored), "payload_sha256": hashlib.sha256(stored).hexdigest(), "tail_crc32": zlib.crc32(stored[-64:]),
                        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": _feature(found),
                    })
                else:
                    rows.append(found)
            arrow = ARROW_DIGESTS if digests else ARROW_FEATURES
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array([r[f.name] for r in rows], f.type) for f in arrow], [*keep, *arrow.names])

    return source.mapInArrow(tidy(read), f"{kept}, {DIGESTS if digests else FEATURES}")


ARROW_FEATURES = pa.schema([("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("n_samples", pa.int64()), ("duration_ms", pa.int64()), ("key_offsets", pa.list_(pa.int64())), ("key_sizes", pa.list_(pa.int64()))])
ARROW_DIGESTS = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(encode_media(docs), keep=("doc_id", "n_bytes"), digests=True)
