"""Copies of lines with the errors that recognisers make, the same for a seed whatever the partitions.

A draw is a number in [0, 1) made of a hash of the seed, the row's id, the copy and the edit, so it depends on
nothing else; an edit's draws are the hash's parts. Hashes and edits of many copies are made at once, in numpy over
Arrow batches: a copy is a row of codes, ASCII as it is and what else a batch has behind it, and is edited in place.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.functions import hashes

#: Copies of a line, their seed and how strongly they are garbled; most edits of a text, and characters for each.
COPIES, SEED, LEVEL, MOST_EDITS, CHARACTERS = 15, 123, 1.2, 4, 12
#: What a character, or two, is misread as (fixed values).
CONFUSED = {
    "O": "0", "o": "0", "0": "O", "l": "1", "I": "1", "1": "l", "S": "5", "s": "5", "5": "S", "B": "8", "8": "B", "G": "6", "6": "G", "Z": "2", "2": "Z", "A": "4", "4": "A", "E": "3", "3": "E",
    "a": "@", "e": "c", "c": "e", "m": "rn", "rn": "m", "w": "vv", "vv": "w", "d": "cl", "U": "0", "T": "7", ".": "", ",": "", ":": "", "-": "", " ": "",
}
#: Characters that are put in (fixed values), and where the kinds of edits begin: misread, lost, joined, other case, put in.
PUT_IN, LOST, JOINED, CASE, MORE = ".,:;|!1il ", 0.55, 0.70, 0.80, 0.90
#: Chances that two characters are misread as one, and a character as one it is confused with.
BOTH, LIKE = 0.5, 0.8
#: Bits of a draw; copies that are edited together, and codes of them, at most.
_BITS, ROWS, CODES = 24, 8192, 1 << 20


def edits_of(text: Column, level: float) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MOST_EDITS), F.floor(F.length(text) / CHARACTERS * level).cast("int") + 1))


def hashed(key: Column, edits: Column, n: int, seed: int) -> Column:
    """The MD5 of seed:key:copy:edit for n copies and their edits, one behind the other; a null key is left out."""

    @F.arrow_udf("binary")
    def md5(keys: pa.Array, edits: pa.Array) -> pa.Array:
        heads, made = [k.encode() for k in keys.to_pylist()], [b""] * len(keys)
        each = edits.to_numpy()
        for k in np.unique(each).tolist():
            rows = np.flatnonzero(each == k).tolist()
            found = hashes.md5([heads[i] for i in rows], [f":{c}:{e}".encode() for c in range(1, n + 1) for e in range(1, k + 1)])
            for i, digests in zip(rows, found.astype("<u4", copy=False), strict=True):
                made[i] = digests.tobytes()
        return pa.array(made, pa.binary())

    return md5(F.concat_ws(":", F.lit(str(seed)), key), edits)


class _Table(NamedTuple):
    """What characters become, by their codes. What is put in a text is a row of `put` (codes, of which `size` count): a code's own row is the character."""

    alphabet: np.ndarray
    put: np.ndarray
    size: np.ndarray
    like: np.ndarray
    case: np.ndarray
    letter: np.ndarray
    pairs: list[tuple[int, int, int]]
    nothing: int


def _other_case(ch: str) -> str:
    return ch.upper() if unicodedata.category(ch) == "Ll" else ch.lower()


@functools.lru_cache(16)
def _table(others: str) -> _Table:
    """others: the characters beyond ASCII. They, and what they may become, have the codes behind ASCII's."""
    code = {ch: i for i, ch in enumerate([*map(chr, range(128)), *others])}
    new = list(code)
    for ch in new:
        for x in _other_case(ch):
            if x not in code:
                code[x] = len(code)
                new.append(x)
    case = [_other_case(ch) for ch in code]
    texts = list(dict.fromkeys([*code, "", *CONFUSED.values(), *case]))
    at = {x: i for i, x in enumerate(texts)}
    put = np.zeros((len(texts), max(map(len, texts))), np.uint32)
    for row, x in zip(put, texts, strict=True):
        row[: len(x)] = [code[ch] for ch in x]
    like = np.array([at.get(CONFUSED.get(ch, CONFUSED.get(ch.lower())), -1) for ch in code])
    letter = np.array([unicodedata.category(ch)[0] == "L" for ch in code])
    pairs = [(code[k[0]], code[k[1]], at[v]) for k, v in CONFUSED.items() if len(k) == 2]
    return _Table(np.array([*map(ord, code)], np.uint32), put, np.array([*map(len, texts)]), like, np.array([at[x] for x in case]), letter, pairs, at[""])


def _share(x: float) -> int:
    """A draw, as a whole number, is less than this just where it is less than x."""
    return math.ceil(x * (1 << _BITS))


def _draws(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """The five draws, in 1 / 2^24, of hashes as (4, n) words of 32 bits."""
    a, b, c, d = words
    return a >> 8, (a & 0xFF) << 16 | b >> 16, (b & 0xFFFF) << 8 | c >> 24, c & 0xFFFFFF, d >> 8


def _edit(codes: np.ndarray, length: np.ndarray, words: np.ndarray, t: _Table) -> None:
    """One edit of each text, in place. codes: (texts, places), zeros behind a text's end, with room for the edit; words: the hashes' (4, texts)."""
    width = codes.shape[1]
    flat, begin = codes.reshape(-1), np.arange(0, codes.size, width)
    kind, where, a, b, c = _draws(words)
    at = where * length >> _BITS
    ch, after = flat[begin + at], flat[begin + at + 1]
    # misread, then the other kinds
    like = t.like[ch]
    put = np.where((like >= 0) & (b < _share(LIKE)), like, np.where(t.letter[ch], ord("a") + (c * 26 >> _BITS), ch))
    gone = np.ones(len(codes), np.int64)
    for one, two, both in t.pairs:
        rows = np.flatnonzero((ch == one) & (after == two) & (a < _share(BOTH)))
        put[rows], gone[rows] = both, 2
    other = np.flatnonzero(kind >= _share(LOST))
    put[other], gone[other] = t.nothing, 1
    rows = np.flatnonzero((kind >= _share(JOINED)) & (kind < _share(CASE)))
    spaces = codes[rows] == ord(" ")
    at[rows] = np.where(spaces.any(axis=1), spaces.argmax(axis=1), at[rows])
    rows = np.flatnonzero((kind >= _share(CASE)) & (kind < _share(MORE)))
    put[rows] = t.case[ch[rows]]
    rows = np.flatnonzero(kind >= _share(MORE))
    put[rows], gone[rows] = np.frombuffer(PUT_IN.encode(), np.uint8)[a[rows] * len(PUT_IN) >> _BITS], 0
    rows = np.flatnonzero(length == 0)
    put[rows], gone[rows] = t.nothing, 0
    # what comes after the edit moves, then the new characters are set
    size = t.size[put]
    by = size - gone
    for n in np.unique(by[by != 0]):
        rows = np.flatnonzero(by == n)
        old = codes[rows]
        moved = np.zeros_like(old)
        if n < 0:
            moved[:, :n] = old[:, -n:]
        else:
            moved[:, n:] = old[:, :-n]
        codes[rows] = np.where(np.arange(width, dtype=np.int32) < (at + size)[rows, None].astype(np.int32), old, moved)
    for k in range(t.put.shape[1]):
        rows = np.flatnonzero(size > k)
        flat[begin[rows] + at[rows] + k] = t.put[put[rows], k]
    length += by


def _strings(codes: np.ndarray, length: np.ndarray, t: _Table) -> pa.Array:
    """The first length codes of each row as a text."""
    made = codes[np.arange(codes.shape[1]) < length[:, None]]
    ends = np.concatenate([[0], np.cumsum(length)])
    if made.max(initial=0) < 128:
        data = made.astype(np.uint8, copy=False)
    else:
        points = t.alphabet[made]
        data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])[ends]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def _copies(codes: np.ndarray, size: np.ndarray, of: np.ndarray, words: np.ndarray, t: _Table) -> pa.Array:
    """Texts, of size codes each, after their edits; of: a copy's text; words: the edits' hashes, (edits, 4, copies)."""
    room = len(words) * max(1, t.put.shape[1] - 1) + 1
    made = np.zeros((len(size), size.max() + room), codes.dtype)
    made[np.arange(made.shape[1]) < size[:, None]] = codes
    made, length = made[of], size[of]
    for edit in words:
        _edit(made, length, edit, t)
    return _strings(made, length, t)


def _garbled(texts: pa.Array, digests: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(text's number, copy, garbled text) of n copies of each text, by the digests of their edits; texts of like length come together."""
    values, hashed = texts.fill_null(""), digests.to_pylist()
    size, edits = pc.utf8_length(values).to_numpy().astype(np.int64), np.array([len(x) for x in hashed], np.int64) // (16 * n)
    order = np.lexsort((size, edits))
    size, edits, values = size[order], edits[order], values.to_pylist()
    # a row is a copy of a text: its codes and its hashes lie in the rows' order
    words = np.frombuffer(b"".join([hashed[i] for i in order]), ">u4").reshape(-1, 4)
    codes = np.frombuffer("".join([values[i] for i in order]).encode("utf-32-le"), np.uint32).copy()
    beyond = np.flatnonzero(codes >= 128)
    others, codes[beyond] = np.unique(codes[beyond], return_inverse=True)
    codes[beyond] += 128
    t = _table("".join(map(chr, others)))
    codes = codes.astype(np.min_scalar_type(len(t.alphabet)))
    begin, before = np.concatenate([[0], np.cumsum(size)]), np.cumsum(edits) - edits
    i = 0
    while i < n * len(order):
        k = edits[i // n]
        j = min(i + ROWS, n * int(np.searchsorted(edits, k, "right")))
        while j > i + 1 and (j - i) * size[(j - 1) // n] > CODES:
            j = (i + j) // 2
        first, last, rows = i // n, (j - 1) // n + 1, np.arange(i, j)
        at = n * before[first] + (i - n * first) * k
        own = words[at : at + (j - i) * k].reshape(j - i, k, 4).transpose(1, 2, 0).astype(np.uint32, order="C")
        made, of = _copies(codes[begin[first] : begin[last]], size[first:last], rows // n - first, own, t), order[rows // n]
        yield of, rows % n + 1, pc.if_else(texts.is_valid().take(pa.array(of)), made, None) if texts.null_count else made
        i = j


def _copier(schema: T.StructType, n: int):
    """For mapInArrow: the schema's columns of batches that have `__md5`, too, as they are (copy 0) and with n garbled texts."""

    def garbled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, names = batch.column("text"), schema.names
            put = lambda new, get: pa.record_batch([new[x] if x in new else get(batch.column(x)) for x in names], names=names)
            yield put({"copy": pa.array(np.zeros(len(text), np.int32))}, lambda c: c)
            for rows, copy, made in _garbled(text.cast(pa.string()), batch.column("__md5").cast(pa.binary()), n):
                yield put({"copy": pa.array(copy.astype(np.int32)), "text": made.cast(text.type)}, lambda c, at=pa.array(rows): c.take(at))

    return garbled


def copies(lines: DataFrame, key: str = "id", n: int = COPIES, seed: int = SEED, level: float = LEVEL) -> DataFrame:
    """lines (key, text, …) and n garbled copies of each, with copy (0: as it is). Rows of one key and text get the same copies."""
    df = lines.withColumn("copy", F.lit(0))
    if n < 1:
        return df
    own = lines.withColumn("__md5", hashed(F.col(key).cast("string"), edits_of(F.col("text"), level), n, seed))
    return own.mapInArrow(_copier(df.schema, n), df.schema)
