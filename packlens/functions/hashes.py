"""MD5 of many short texts at once, in numpy: what F.md5 gives, for hashes that outnumber the rows they are made of."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: A block's bytes, and those that a text may have to fit one; texts that are hashed together, about.
BLOCK, SHORT, ROWS = 64, 55, 16384
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_ADD = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _digests(words: list[np.ndarray | None], shape: tuple[int, int]) -> np.ndarray:
    """Digests (*shape, 4), in words, of one block each; words: the block's sixteen of 32 bits, in shapes that fit, None for zeros."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        a += f
        a += _ADD[i]
        if words[k] is not None:
            a += words[k]
        turn = _TURN[i // 16][i % 4]
        np.left_shift(a, turn, out=f)
        a >>= 32 - turn
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)], axis=-1)


def _words(rows: list[bytes]) -> np.ndarray:
    """Sixteen words (16, rows) of each row, zeros behind it."""
    return np.frombuffer(b"".join(x.ljust(BLOCK, b"\0") for x in rows), "<u4").reshape(-1, 16).T.astype(np.uint32, order="C")


def md5(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """Digests, as words (heads, tails, 4) of 32 bits, of each head with each tail behind it; tails are short.

    Heads of one length are hashed together: most words of their blocks are the head's or the tail's alone.
    """
    out = np.empty((len(heads), len(tails), 4), np.uint32)
    sizes = np.array([len(h) for h in heads], np.int64)
    most = SHORT - max(map(len, tails), default=0)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if size > most:
            for i in rows:
                out[i] = np.frombuffer(b"".join(hashlib.md5(heads[i] + t).digest() for t in tails), "<u4").reshape(-1, 4)
            continue
        end = _words([b"\0" * size + t + b"\x80" for t in tails])
        end[14] = [8 * (size + len(t)) for t in tails]
        end = end[:, :, None]
        step = max(1, ROWS // max(1, len(tails)))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            start = _words([heads[x] for x in own])
            # the head ends within a word, or before it
            parts = [start[k] if 4 * k + 4 <= size else start[k] | end[k] if 4 * k < size else end[k] for k in range(16)]
            out[own] = _digests([x if x.any() else None for x in parts], (len(tails), len(own))).transpose(1, 0, 2)
    return out
