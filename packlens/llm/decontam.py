"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Items are partitioned by the size of their shingle sets. Each item is indexed under its smallest shingle
hashes, one more than it may miss, so that a document which contains the item holds one of them. A
document is searched only in the partitions it is large enough for, and exact containment of the
item's shingles decides. The items are searched in blocks of bounded size, each sent to the
executors once, whatever their number.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, npwords

#: UTF-8 bytes of items that are searched in one pass over the documents.
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long"


class Index:
    """Items of one block: per shingle width and size class, retained values and their items."""

    def __init__(self, ids: list[int | None], texts: list[str], containment: float, width: int):
        self.ids, self.sets, self.parts = ids, [], []
        held: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        offsets, data = npwords.text_bytes(pa.array(texts, pa.string()))
        self.need = []
        for i, j, firsts, h in npwords.rows(offsets, data):
            for k, s in zip(range(i, j), npwords.shingles(firsts, h, width), strict=True):
                s = np.unique(s)
                n = len(s)
                self.sets.append(s)
                self.need.append(max(1, math.ceil(containment * n - 1e-9)))
                n_words = int(firsts[k - i + 1] - firsts[k - i])
                if n:
                    part = held[min(n_words, width), n.bit_length()]
                    for v in s[: n - self.need[-1] + 1].tolist():
                        part[v].append(k)
        for (w, size), values in sorted(held.items()):
            smallest = max(1, math.ceil(containment * (1 << (size - 1)) - 1e-9))
            at = np.array(sorted(values), np.uint64)
            self.parts.append((w, smallest, at, [values[int(v)] for v in at]))

    def search(self, by_width: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of items contained in a document with these shingle sets."""
        for w, smallest, values, items in self.parts:
            s = by_width[w]
            if len(s) < smallest:
                continue
            at = np.minimum(np.searchsorted(values, s), len(values) - 1)
            for k in {k for v in at[values[at] == s].tolist() for k in items[v]}:
                own = self.sets[k]
                found = np.minimum(np.searchsorted(s, own), len(s) - 1)
                shared = int(np.count_nonzero(s[found] == own))
                if shared >= self.need[k]:
                    yield k, shared


def indexes(items: DataFrame, containment: float, width: int, block_bytes: int) -> Iterator[Index]:
    """The items with words, block by block; about block_bytes of them are on the driver at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(base.WORD))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        if rows:
            yield Index([r.item_id for r in rows], [r.text for r in rows], containment, width)


def contained(docs: DataFrame, items: DataFrame, containment: float = base.SIMILARITY, width: int = base.SHINGLE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment: items whose shingles are in a document by the share at least.

    Words are lower-cased (A-Z); an item with fewer words than the width is one shingle of them all and
    is looked for among the document's word runs of that length. Items or documents that are null
    or without words match nothing. Null ids are carried, repeated rows match each. An empty table on
    either side gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], SCHEMA)
    for index in indexes(items, containment, width, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # of about block_bytes of items; the driver keeps a file of it
        found = found.unionByName(docs.mapInArrow(_searcher(shared, width), SCHEMA))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def hits(index: Index, width: int, column: pa.Array) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the texts in a column."""
    widths = sorted({w for w, *_ in index.parts})
    offsets, data = npwords.text_bytes(column)
    for i, _, firsts, h in npwords.rows(offsets, data):
        flat = {w: npwords.windows(h, w) for w in widths}
        bounds = firsts.tolist()
        for k in range(len(bounds) - 1):
            a, b = bounds[k], bounds[k + 1]
            for x, n in index.search({w: np.unique(s[a : max(a, b - w + 1)]) for w, s in flat.items()}):
                yield i + k, x, n


def _searcher(shared, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = list(hits(index, width, batch.column("text")))
            at, item, common = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([index.ids[x] for x in item], pa.int64()), pa.array([len(index.sets[x]) for x in item], pa.int64()), pa.array(common, pa.int64())],
                names=["doc_id", "item_id", "n_item", "n_shared"],
            )

    return search


def _cleaner(shared, width: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[i for i, _, _ in hits(index, width, batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return clean


def clean_documents(docs: DataFrame, items: DataFrame, containment: float = base.SIMILARITY, width: int = base.SHINGLE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs whose text contains no item; each block of items filters what the one before has left.

    Null and wordless texts contain none and stay; repeated rows go or stay together; all columns pass through.
    """
    for index in indexes(items, containment, width, block_bytes):
        docs = docs.mapInArrow(_cleaner(docs.sparkSession.sparkContext.broadcast(index), width), docs.schema)
    return docs


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(base.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, u, l), '[^\x20\x09-\x0D]+') AS ws FROM documents, low),
b AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, u, l), '[^\x20\x09-\x0D]+') AS ws FROM benchmark, low),
bw AS (SELECT *, least(5, len(ws)) AS w FROM b WHERE len(ws) > 0),
bs AS (SELECT DISTINCT iid, item_id, w, list_slice(ws, i, i + w - 1) AS g FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS i FROM bw)),
bn AS (SELECT iid, count(*) AS n FROM bs GROUP BY iid),
ds AS (SELECT DISTINCT rid, doc_id, g FROM (SELECT rid, doc_id, list_slice(ws, i, i + w - 1) AS g
       FROM (SELECT rid, doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM d, (SELECT DISTINCT w FROM bw) WHERE len(ws) >= w)))
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared, count(*)::DOUBLE / n AS containment
FROM ds JOIN bs ON ds.g = bs.g JOIN bn USING (iid) GROUP BY rid, doc_id, iid, item_id, n HAVING 4 * count(*) >= 3 * n
"""
