"""Removal of repeated byte strings by depth-limited radix sorting of suffixes (operator 5).

Suffixes are ordered through the threshold length only, in passes over their digits, the most significant
first. A suffix leaves as soon as its group holds one document only; groups that are left after the
last digit are exactly the repeated windows. Digits are cut so that neighbouring suffixes travel together:

1. First digit: the least gram (by hash) among the window's own bytes, as in minimum substring
   partitioning. Neighbouring windows have it in common, so a run of them is one entry.
2. Second digit: the bytes of the whole run. Of equal runs the smallest document's stays, all others go.
   Where a gram has one kind of run only, that is all.
3. Remaining digits: where a gram has several kinds of runs (at the ends of repeated passages), one run
   of each kind sends its bytes. The eight bytes next to the gram are the next digit, which spreads a
   frequent gram; then the windows' own bytes follow, eight at a time, to the threshold.

Each pass hands packed blocks of a batch to buckets of the digit. What a batch can settle by itself goes
first: of a passage that many of its documents share, one entry is sent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, npwords

#: Threshold in bytes, bytes of a gram, bytes of text that a bucket stands for and that are worked on at once.
DEPTH, GRAM, BUCKET_BYTES, PART_BYTES = 50, 20, 8 << 20, 4 << 20
#: Windows that are ordered at once, bytes of a digit, bytes hashed at once, bytes of an Arrow batch.
AT_ONCE, DIGIT, SEGMENT, BATCH = 1 << 18, 8, 1 << 18, "4m"
#: A null id orders after all others.
NULL_ID = (1 << 63) - 1
LOW = np.uint64((1 << 20) - 1)
#: Rows of a pass: packed entries for a bucket, windows that go, runs whose bytes are asked for.
BLOCK, GONE, ASKED = 0, 1, 2
#: Windows of a run that an item of GONE can mark; an item is the first window's position and a mask.
MOST = 31
SENT = "bucket long, kind int, doc long, rid long, data binary"
ANSWER = "kind int, doc long, rid long, data binary"


def represented(offsets: np.ndarray, data: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, gram position, first window, number of windows, gram hash, run hash) of each run of windows with one gram.

    Positions are in bytes of data. The bytes are read in overlapping segments, so that one run may
    come in two parts; a window's gram doesn't depend on that.
    """
    power, inverse = npwords.powers()
    width, low, high = depth - gram + 1, int(offsets[0]), int(offsets[-1])
    closed = np.zeros(high - low + 1, np.int8)
    lengths = np.diff(offsets)
    firsts, lasts = offsets[:-1][lengths > 0] - low, offsets[1:][lengths > 0] - low
    np.add.at(closed, np.maximum(firsts, lasts - depth + 1), 1)
    np.add.at(closed, lasts, -1)
    open_ = np.cumsum(closed[:-1], dtype=np.int8) == 0
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    at = low
    while at + depth <= high:
        end = min(high, at + SEGMENT)
        part = data[at:end]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(npwords.TABLE_EXACT[part] * power[: len(part)], out=total[1:])
        grams = npwords.mix((total[gram:] - total[:-gram]) * inverse[: len(part) - gram + 1])
        keys = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        n = len(grams) - width + 1
        padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(keys)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & LOW).astype(np.int64)
        valid = np.flatnonzero(open_[at - low : at - low + n])
        if len(valid):
            gram_at = chosen[valid]
            new = np.flatnonzero(np.concatenate([[True], (gram_at[1:] != gram_at[:-1]) | (valid[1:] != valid[:-1] + 1)]))
            first, gram_at, count = valid[new], gram_at[new], np.diff(np.append(new, len(valid)))
            # the number of windows and the gram's place are part of a run's hash
            shape = (count * 64 + gram_at - first).astype(np.uint64) * npwords.TURNS[0]
            run = npwords.mix((total[first + count + depth - 1] - total[first]) * inverse[first] + shape)
            # least hashes are small ones: mixed again, so that buckets are even
            for to, x in zip(found, (gram_at + at, first + at, count, npwords.mix(grams[gram_at] + npwords.TURNS[1]), run), strict=True):
                to.append(x)
        at += len(part) - depth + 1
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    gram_at, first, count, h, run = (np.concatenate([*x, np.zeros(0, k)]) for x, k in zip(found, kinds, strict=True))
    return np.searchsorted(offsets, first, "right") - 1, gram_at, first, count, h, run


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes, ids, row keys) of parts of a bounded size, one row at least."""
    for batch in batches:
        offsets, _ = npwords.text_bytes(batch.column("text"))
        for i, j in npwords.chunks(offsets, PART_BYTES):
            part = batch.slice(i, j - i)
            yield part, *npwords.text_bytes(part.column("text")), part.column("doc").to_numpy(), part.column("rid").to_numpy()


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.int64(len(arrays[0])).tobytes(), *(x.tobytes() for x in arrays)])


def unpacked(data: memoryview, *kinds: tuple) -> tuple[list[np.ndarray], memoryview]:
    """Arrays of one length, and what follows them."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind, width in kinds:
        out.append(np.frombuffer(data, kind, n * width, at).reshape((n, width) if width > 1 else n))
        at += out[-1].nbytes
    return out, data[at:]


def changes(*sorted_columns: np.ndarray) -> np.ndarray:
    """First index of each run of equal rows."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = False
    for x in sorted_columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def spread(of_runs: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A value of each run for each of its rows."""
    return np.repeat(of_runs, np.diff(np.append(starts, n)))


def blocks_of(buckets: np.ndarray, pack) -> pa.RecordBatch:
    """A row for each run of equal buckets, with what pack gives for the slice."""
    starts = changes(buckets)
    data = [pack(slice(a, b)) for a, b in zip(starts, [*starts[1:], len(buckets)], strict=True)]
    none = pa.nulls(len(data), pa.int64())
    return pa.record_batch([pa.array(buckets[starts].astype(np.int64)), pa.array(np.full(len(data), BLOCK, np.int32)), none, none, pa.array(data, pa.binary())], names=["bucket", "kind", "doc", "rid", "data"])


def answers(kind: int, doc: np.ndarray, rid: np.ndarray, item: np.ndarray, bits: int | None = None) -> pa.RecordBatch:
    """A row for each document row, with its items one after another; with bits, addressed to any bucket."""
    order = np.lexsort((rid, doc))
    doc, rid, item = doc[order], rid[order], item[order].astype(np.int64)
    starts = changes(doc, rid)
    offsets = np.append(starts, len(doc)).astype(np.int32) * 8
    data = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(item)])
    columns = [pa.array(np.full(len(starts), kind, np.int32)), pa.array(doc[starts]), pa.array(rid[starts]), data]
    names = ["kind", "doc", "rid", "data"]
    if bits is not None:
        columns, names = [pa.array(rid[starts] & ((1 << bits) - 1)), *columns], ["bucket", *names]
    return pa.record_batch(columns, names=names)


def settled(batches: Iterator[pa.RecordBatch], settle) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: answers pass through, a bucket's blocks are settled together."""
    bucket, held = None, []
    for batch in batches:
        is_block = batch.column("kind").to_numpy() == BLOCK
        through = batch.filter(pa.array(~is_block))
        if through.num_rows:
            yield through.select(["kind", "doc", "rid", "data"])
        for i in np.flatnonzero(is_block).tolist():
            b = batch.column("bucket")[i].as_py()
            if b != bucket:
                if held:
                    yield from settle(held)
                bucket, held = b, []
            held.append(memoryview(batch.column("data")[i].as_py()))
    if held:
        yield from settle(held)


def through_buckets(rows: DataFrame, settle) -> DataFrame:
    sorted_rows = rows.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_rows.mapInArrow(lambda batches: settled(batches, settle), ANSWER)


def gone_item(at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return (at.astype(np.int64) << MOST) | mask


def whole(n: np.ndarray) -> np.ndarray:
    return (np.int64(1) << n.astype(np.int64)) - 1


# --- first and second digit


def whole_runs(docs: DataFrame, bits: int, depth: int, gram: int) -> DataFrame:
    """(kind, doc, rid, data): runs that go as a whole, and runs of which the bytes are asked for."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, offsets, data, ids, rids in parts_of(batches):
            row, gram_at, first, n, h, run = represented(offsets, data, depth, gram)
            if not len(row):
                continue
            order = np.lexsort((ids[row], run, h))
            row, gram_at, first, n, h, run = (x[order] for x in (row, gram_at, first, n, h, run))
            doc, at = ids[row], first - offsets[row]
            starts = changes(h, run)
            gone = doc > spread(doc[starts], starts, len(doc))
            yield answers(GONE, doc[gone], rids[row[gone]], gone_item(at[gone], whole(n[gone])), bits)
            row, h, run = row[~gone], h[~gone], run[~gone]
            at, shape = at[~gone].astype(np.uint32), ((n << 8) | (gram_at - first))[~gone].astype(np.uint16)
            # of the gram's hash, the bucket and 32 bits after it: grams that share them are only held to be one until their bytes are read
            digit = (h << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)

            def pack(part: slice, row=row, digit=digit, run=run, at=at, shape=shape, ids=ids, rids=rids) -> bytes:
                used, index = np.unique(row[part], return_inverse=True)
                kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
                return packed(ids[used], rids[used]) + packed(digit[part], run[part], at[part], shape[part], index.astype(kind))

            yield blocks_of(h >> np.uint64(64 - bits), pack)

    def settle(blocks: list[memoryview]) -> Iterator[pa.RecordBatch]:
        parts = []
        for x in blocks:
            (ids, rids), x = unpacked(x, (np.int64, 1), (np.int64, 1))
            (h, run, at, shape, index), _ = unpacked(x, (np.uint32, 1), (np.uint64, 1), (np.uint32, 1), (np.uint16, 1), (np.uint16 if len(ids) <= 1 << 16 else np.uint32, 1))
            parts.append((h, run, (at.astype(np.int64) << 16) | shape, ids[index], rids[index]))
        blocks.clear()
        h, run, asked, doc, rid = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((doc, run, h))
        h, run, asked, doc, rid = (x[order] for x in (h, run, asked, doc, rid))
        starts = changes(h, run)
        least = doc[starts]
        gone = doc > spread(least, starts, len(doc))
        yield answers(GONE, doc[gone], rid[gone], gone_item(asked[gone] >> 16, whole((asked[gone] >> 8) & 255)))
        # runs that differ under one gram may still have windows in common, if documents differ
        groups = changes(h[starts])
        several = spread(np.minimum.reduceat(least, groups) != np.maximum.reduceat(least, groups), groups, len(starts))
        open_ = spread(several, starts, len(doc)) & ~gone
        yield answers(ASKED, doc[open_], rid[open_], asked[open_])

    return through_buckets(docs.select("doc", "rid", "text").mapInArrow(send, SENT), settle)


# --- remaining digits


def repeated(run: np.ndarray, offset: np.ndarray, group: np.ndarray, doc: np.ndarray, text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of windows that a smaller document has too, among windows in groups, by digits of their bytes."""
    flat, length = text.reshape(-1), text.shape[1]
    place = run * length + offset
    for k in range(0, depth, DIGIT):
        size = min(DIGIT, depth - k)
        digit = np.zeros((len(place), DIGIT), np.uint8)
        digit[:, :size] = flat[place[:, None] + np.arange(k, k + size)]
        digit = digit.view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        place, group, digit = place[order], group[order], digit[order]
        starts, docs = changes(group, digit), doc[place // length]
        least = np.minimum.reduceat(docs, starts)
        several = spread(least != np.maximum.reduceat(docs, starts), starts, len(place))
        group = spread(np.arange(len(starts)), starts, len(place))[several]
        docs, place, least = docs[several], place[several], spread(least, starts, len(several))[several]
        if not len(place):
            break
    gone = docs > least
    return place[gone] // length, place[gone] % length


def windows_of(n: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    run = np.repeat(np.arange(len(n)), n)
    return run + first, np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)


def window_passes(n: np.ndarray, group: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run, offset) of windows in sets of about AT_ONCE that no group goes across; runs are sorted by group.

    A group with more windows is passed over several times, each time for a share of its first digits.
    """
    starts = changes(group)
    ends = np.append(starts[1:], len(group))
    upto = np.cumsum(n)
    a = 0
    while a < len(starts):
        before = upto[starts[a]] - n[starts[a]]
        b = max(a + 1, int(np.searchsorted(upto[ends - 1], before + AT_ONCE, "right")))
        low, high = starts[a], ends[b - 1]
        shares = -(-int(upto[high - 1] - before) // AT_ONCE) if b == a + 1 else 1
        for share in range(shares):
            found = []
            for x in range(low, high, AT_ONCE // MOST):
                run, offset = windows_of(n[x : min(high, x + AT_ONCE // MOST)], x)
                if shares > 1:
                    digit = np.ascontiguousarray(text[run[:, None], offset[:, None] + np.arange(DIGIT)]).view(np.uint64).ravel()
                    own = npwords.mix(digit) % np.uint64(shares) == np.uint64(share)
                    run, offset = run[own], offset[own]
                found.append((run, offset))
            run, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(run):
                yield run, offset
        a = b


def remaining_digits(docs: DataFrame, asked: DataFrame, bits: int, depth: int, gram: int) -> DataFrame:
    """(kind, doc, rid, data): windows of the runs asked for that go."""
    most = depth - gram + 1
    length, next_to = depth + most - 1, min(DIGIT, (depth - gram) // 2)
    weights = npwords.mix(np.arange(1, gram + next_to + 1, dtype=np.uint64)) | np.uint64(1)
    kinds = ((np.uint64, 1), (np.int64, 1), (np.int64, 1), (np.uint32, 1), (np.uint8, 1), (np.uint8, length))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offsets, data, ids, rids in parts_of(batches):
            items = [np.frombuffer(b"".join(x), np.int64) for x in batch.column("asked").to_pylist()]
            row, item = np.repeat(np.arange(len(items)), [len(x) for x in items]), np.concatenate(items)
            for a in range(0, len(row), AT_ONCE // MOST):  # bounded memory for the matrices of bytes
                yield blocks(*sided(row[a : a + AT_ONCE // MOST], item[a : a + AT_ONCE // MOST], offsets, data), offsets, data, ids, rids)

    def sided(row, item, offsets, data):
        """(row, first window, number of windows, group) after the next digit: the bytes behind the gram, for windows without those the ones before it."""
        first, n, g = offsets[row] + (item >> 16), (item >> 8) & 255, item & 255
        split = np.clip(g - (depth - gram - next_to), 0, n)  # earlier windows end before those bytes do
        out = []
        for side, low, high in ((0, split, n), (1, np.zeros_like(n), split)):
            some = high > low
            at = (first + g)[some] - side * next_to
            key = npwords.mix((data[at[:, None] + np.arange(gram + next_to)] * weights).sum(axis=1, dtype=np.uint64) + np.uint64(side))
            out.append((row[some], (first + low)[some], (high - low)[some], key))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def blocks(row, first, n, key, offsets, data, ids, rids) -> pa.RecordBatch:
        order = np.argsort(key, kind="stable")
        row, first, n, key = row[order], first[order], n[order], key[order]
        reach = np.arange(length)
        text = np.where(reach < (n + depth - 1)[:, None], data[np.minimum(first[:, None] + reach, len(data) - 1)], 0).astype(np.uint8)
        doc, rid, at, n = ids[row], rids[row], (first - offsets[row]).astype(np.uint32), n.astype(np.uint8)
        return blocks_of(key >> np.uint64(64 - bits), lambda part: packed(key[part], doc[part], rid[part], at[part], n[part], text[part]))

    def settle(blocks: list[memoryview]) -> Iterator[pa.RecordBatch]:
        key, doc, rid, at, n, text = (np.concatenate(x) for x in zip(*(unpacked(x, *kinds)[0] for x in blocks), strict=True))
        blocks.clear()
        order = np.argsort(key, kind="stable")
        key, doc, rid, at, n, text = (x[order] for x in (key, doc, rid, at, n, text))
        n = n.astype(np.int64)
        marks = np.zeros(len(key), np.int64)
        for run, offset in window_passes(n, key, text):
            run, offset = repeated(run, offset, key[run], doc, text, depth)
            np.bitwise_or.at(marks, run, np.int64(1) << offset)
        some = marks != 0
        yield answers(GONE, doc[some], rid[some], gone_item(at[some], marks[some]))

    wanted = asked.groupBy("doc", "rid").agg(F.collect_set("data").alias("asked"))
    rows = docs.select("doc", "rid", "text").join(wanted, ["doc", "rid"])
    return through_buckets(rows.mapInArrow(send, SENT), settle)


# --- removal


def cut(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch, offsets, data, _, _ in parts_of(batches):
        starts, ends, kept = [], [], []
        for i, found in enumerate(batch.column("gone").to_pylist()):
            own = data[offsets[i] : offsets[i + 1]]
            if not found:
                starts.append([])
                ends.append([])
                kept.append(own.tobytes())
                continue
            item = np.frombuffer(b"".join(found), np.int64)
            entry, offset = np.nonzero(((item & ((1 << MOST) - 1))[:, None] >> np.arange(MOST)) & 1)
            at = (item >> MOST)[entry] + offset
            edges = np.bincount(at, minlength=len(own) + 1) - np.bincount(at + depth, minlength=len(own) + 1)
            covered = np.cumsum(edges[:-1]) > 0
            step = np.diff(covered.astype(np.int8), prepend=0, append=0)
            starts.append(np.flatnonzero(step == 1).tolist())
            ends.append(np.flatnonzero(step == -1).tolist())
            kept.append(own[~covered].tobytes())
        longs = pa.list_(pa.int64())
        yield pa.record_batch(
            [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "starts", "ends", "kept"],
        )


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, starts, ends (byte spans removed, end exclusive) and kept (the other bytes) for every row.

    A byte goes if a string of `depth` bytes over it also starts in a document with a smaller doc_id.
    A null text is empty. A null doc_id orders after all others; rows with one id don't remove from
    each other. An empty table gives no rows; other columns are ignored. Long texts are read in segments,
    whole. What is left need not be valid UTF-8, so it is binary. Whole runs are compared by 128 bits of
    hash, windows of runs that differ by their bytes.
    """
    if not 0 < gram <= depth < gram + MOST:
        raise ValueError(f"a gram must have {depth - MOST + 1} to {depth} bytes")
    text = base.text_of()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), base.row_key(text).alias("rid"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    with base.conf(docs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        found = base.keep(whole_runs(docs, bits, depth, gram), "whole_runs")
        more = base.keep(remaining_digits(docs, found.where(F.col("kind") == ASKED), bits, depth, gram), "windows")
    marks = found.where(F.col("kind") == GONE).unionByName(more).groupBy("doc", "rid").agg(F.collect_set("data").alias("gone"))
    rows = docs.join(marks, ["doc", "rid"], "left").select("doc_id", "doc", "rid", "text", "gone")
    return rows.mapInArrow(lambda b: cut(b, depth), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = remove_repeats(base.documents(spark, sf_dir))
    removed = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every window by its hex digits, texts in pieces so that a window is near its piece's start.
OP5_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, doc, c * 500 AS o, substr(h, c * 1000 + 1, 1098) AS s FROM (SELECT *, unnest(range(0, (length(h) // 2 + 499) // 500)) AS c FROM d)),
w AS (SELECT r, doc, o + i AS pos, substr(s, 2 * i + 1, 100) AS k FROM (SELECT *, unnest(range(0, least(500, length(s) // 2 - 49))) AS i FROM c WHERE length(s) >= 100)),
m AS (SELECT k, min(doc) AS low FROM w GROUP BY k HAVING min(doc) < max(doc)),
g AS (SELECT r, pos, lag(pos) OVER (PARTITION BY r ORDER BY pos) AS before FROM w JOIN m USING (k) WHERE doc > low),
i AS (SELECT r, pos, sum(CASE WHEN before IS NULL OR pos > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY pos) AS span FROM g),
s AS (SELECT r, min(pos) AS a, max(pos) + 50 AS b FROM i GROUP BY r, span),
p AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS x, a AS y FROM s UNION ALL SELECT r, max(b), NULL FROM s GROUP BY r),
k AS (SELECT r, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS kept FROM p JOIN d USING (r) GROUP BY r),
t AS (SELECT r, sum(b - a) AS n, count(*) AS spans FROM s GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN k USING (r)
"""
