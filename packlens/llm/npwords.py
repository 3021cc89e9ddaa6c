"""Words and word shingles of UTF-8 texts as 64-bit hashes, in numpy over whole Arrow columns.

A word's hash is a polynomial over a random table of bytes, so that all words of a segment come from
one running sum. The table gives A-Z the values of a-z: hashes are of words with A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
CHUNK_BYTES = 1 << 22

_random = np.random.Generator(np.random.PCG64(20240229))
TABLE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The table without the letters' folding.
TABLE_EXACT = TABLE.copy()
TABLE[65:91] = TABLE[97:123]
TURNS = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, made when first used in a process."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(SEGMENT + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, nulls as empty texts."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each row and one past the last, starts, ends) in bytes of data; words end with their row."""
    inside = ~SPACE[data]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    before[firsts] = False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    after[firsts[firsts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(starts, offsets), starts, ends


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = powers()
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        low = starts[i]
        j = int(np.searchsorted(ends, low + SEGMENT, "right"))
        if j == i:  # a word longer than a segment
            out[i] = int.from_bytes(hashlib.blake2b(data[low : ends[i]].tobytes().lower(), digest_size=8).digest(), "little")
            i += 1
            continue
        high = ends[j - 1]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(TABLE[data[low:high]] * power[: high - low], out=total[1:])
        at = starts[i:j] - low
        out[i:j] = (total[ends[i:j] - low] - total[at]) * inverse[at]
        i = j
    return mix(out)


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes, over row bounds too; the width is part of it."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, TURNS[32 + width], np.uint64)
    for k in range(width):
        total += h[k : k + n] * TURNS[k]
    return mix(total)


def shingles(firsts: np.ndarray, h: np.ndarray, width: int, whole: bool = True) -> Iterator[np.ndarray]:
    """Each row's hashes of word windows; with `whole`, a shorter text is one window of all its words."""
    flat = windows(h, width)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield flat[a : b - width + 1]
        else:
            yield windows(h[a:b], b - a) if whole and b > a else flat[:0]


def rows(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last, first word of each row, word hashes) of each chunk."""
    for i, j in chunks(offsets):
        low, high = offsets[i], offsets[j]
        part = data[low:high]
        firsts, starts, ends = words(offsets[i : j + 1] - low, part)
        yield i, j, firsts, hashes(part, starts, ends)
