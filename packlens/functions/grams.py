"""Character n-grams of short texts, counted in numpy over whole Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are counted together at most.
ROWS = 4096


def counts(texts: pa.Array, least: int, most: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """(text's number, n-gram, how often) of texts whose words have one space on both sides; n-grams of a word and its two spaces, of least (3 or more) to most characters.

    An n-gram and its text are one whole number, its digits being places in the texts' alphabet, so that they
    are counted by a sort. Texts with too many different characters for that are halved.
    """
    joined = "".join(texts.to_pylist())
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(points):
        return
    there = np.zeros(points.max() + 1, bool)
    there[points] = True
    alphabet, code = np.concatenate([[0], np.flatnonzero(there)]), np.cumsum(there)[points]
    size = len(alphabet)
    if len(texts) * size**most >= 1 << 63:
        if len(texts) > 1:
            half = len(texts) // 2
            yield from counts(texts.slice(0, half), least, most)
            for row, grams, n in counts(texts.slice(half), least, most):
                yield row + half, grams, n
        else:
            found = Counter(g for n in range(least, most + 1) for g in (joined[i : i + n] for i in range(len(joined) - n + 1)) if " " not in g[1:-1])
            yield np.zeros(len(found), np.int64), pa.array(list(found), pa.string()), np.array(list(found.values()), np.int64)
        return
    spaces = np.concatenate([[0], np.cumsum(points == 32)])
    value = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy()) * size**most
    keys = []
    for n in range(1, most + 1):
        value = value[: len(points) - n + 1] + code[n - 1 :] * size ** (most - n)
        if n >= least:
            # two texts have two spaces between them, one of which is not at an end
            keys.append(value[spaces[n - 1 : len(points)] == spaces[1 : len(points) - n + 2]])
    keys, found = np.unique(np.concatenate(keys), return_counts=True)
    row, rest = np.divmod(keys, size**most)
    digits = np.empty((len(keys), most), np.int64)
    for k in range(most - 1, -1, -1):
        rest, digits[:, k] = np.divmod(rest, size)
    chars = alphabet[digits]
    widths = np.where(digits > 0, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 0).sum(axis=1)
    data = chars[digits > 0].astype("<u4").tobytes().decode("utf-32-le").encode()
    offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    yield row, pa.StringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(data)), found


def counter(keys: list[str], least: int, most: int):
    """For mapInArrow: (keys, gram, n) of batches of keys and `text`, words in lower case with one space on both sides."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                for row, grams, n in counts(part.column("text"), least, most):
                    own = part.select(keys).take(pa.array(row))
                    yield pa.record_batch([*own.columns, grams, pa.array(n, pa.int64())], names=[*keys, "gram", "n"])

    return of
