"""Compact binary forms of arrays, and block files in the shared folder."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from millrace.llm.common import filesystem


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, compressed one byte plane after the other."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack(lengths: np.ndarray, body: bytes) -> bytes:
    """Lengths and a squeezed or plain body in one binary value."""
    head = squeeze(lengths)
    return struct.pack("<I", len(head)) + head + body


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    (n,) = struct.unpack_from("<I", data)
    return expand(data[4 : 4 + n]), data[4 + n :]


def squeeze48(values: np.ndarray) -> bytes:
    """Unsigned 48-bit integers, compressed one byte plane after the other; sorted runs get shorter."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zstandard.compress(planes.tobytes(), 1)


def expand48(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return out.view("<u8").reshape(-1)


def write_sections(folder: str, sections: list[bytes], suffix: str, number: int) -> str:
    """Writes sections to a file; returns its path.

    The name comes from the task's partition, the number of the file in it and the
    content.  A task that is run again writes the same files again, so whoever read a
    name from either attempt finds the same bytes; equal blocks have files of their own.
    """
    import xxhash
    from pyspark import TaskContext

    body = struct.pack(f"<Q{len(sections)}Q", len(sections), *map(len, sections)) + b"".join(sections)
    task = TaskContext.get()
    name = f"{folder}/{task.partitionId() if task else 0:06d}-{number:06d}-{xxhash.xxh3_128_hexdigest(body)}.{suffix}"
    store, local = filesystem(name)
    with store.open_output_stream(local, compression=None) as f:
        f.write(body)
    return name


def read_sections(name: str) -> list[bytes]:
    store, local = filesystem(name)
    with store.open_input_stream(local, compression=None) as f:
        data = f.read()
    (n,) = struct.unpack_from("<Q", data)
    ends = 8 * (n + 1) + np.cumsum((0, *struct.unpack_from(f"<{n}Q", data, 8)), dtype=np.int64)
    return [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
