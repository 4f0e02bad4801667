"""Hashes of words and of their character n-grams, computed for many words at once."""

from __future__ import annotations

import zlib

import numpy as np

#: Multiplier of the rolling hash and the finaliser's constants (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)


#: The multiplier's inverse modulo 2^64.
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` values, by sums of value times power; equal runs have equal hashes wherever they stand."""
    n = len(values)
    if len(_POWERS[0]) < n:
        most = max(n, 2 * len(_POWERS[0]))
        for k, base in enumerate((BASE, INVERSE)):
            factors = np.full(most, base)
            factors[0] = 1
            _POWERS[k] = np.cumprod(factors)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _POWERS[0][:n])])
    return (sums[size:] - sums[: n - size + 1]) * _POWERS[1][: n - size + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads a hash over all its bits."""
    h = (h ^ (h >> SHIFT)) * MIX
    return h ^ (h >> SHIFT)


def subword_hashes(words: list[str], sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of every word and of the n-grams of ``<word>``; how many each word has.

    A word's own hash comes first, then its n-grams by size and place.
    """
    marked = [f"<{w}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = ends[owner] - np.arange(len(chars))
    whole = mix(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * BASE)
    owners, hashes = [np.arange(len(words))], [whole]
    rolling = np.zeros(len(chars), np.uint64)
    for n in range(1, max(sizes, default=0) + 1):
        if n > len(chars):
            break
        rolling = rolling[: len(chars) - n + 1] * BASE + chars[n - 1 :]
        if n in sizes:
            at = np.flatnonzero(room[: len(rolling)] >= n)
            owners.append(owner[at])
            hashes.append(mix(rolling[at] ^ np.uint64(n)))
    owners, hashes = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.bincount(owners, minlength=len(words))
