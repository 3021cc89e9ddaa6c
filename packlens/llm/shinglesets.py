"""Whole shingle sets of chosen classes: written once, compared exactly in tasks.

A class is what texts with equal shingle sets have in common; c is its id, n its set's size, and set its
sorted 64-bit shingle hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import base, npwords

#: Shingles of one side of a unit that are compared with another block in one task; less are cut into up to SPLIT
#: blocks of SPLIT_SHINGLES all the same, so that a cluster is compared in several tasks.
BLOCK_SHINGLES, SPLIT, SPLIT_SHINGLES = 1 << 20, 4, 1 << 14


def least_overlap(n: int, percent: int) -> int:
    """The fewest elements that a set of n must share with another at a similarity of percent / 100."""
    return -(-percent * n // 100)


def set_id(s: np.ndarray) -> bytes:
    """128 bits of a set's sorted hashes."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([*values, np.zeros(0, np.int64)])))


def arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column without nulls."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy().tolist()
    return [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def row_sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes, as signed numbers."""
    offsets, data = npwords.text_bytes(batch.column("text"))
    for _, _, firsts, h in npwords.rows(offsets, data):
        for s in npwords.shingles(firsts, h, width):
            yield np.unique(s.view(np.int64))


def stored_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(c, n, set) of the classes wanted (c, n_shingles, s1, s2, rid of one of the class's rows), written once.

    rid only spares texts that can't be wanted; a class gets its set by the 128 bits of it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(row_sets(batch, width))
            ids = np.frombuffer(b"".join(set_id(s) for s in sets), np.int64).reshape(-1, 2)
            yield pa.record_batch([pa.array(ids[:, 0]), pa.array(ids[:, 1]), lists(sets)], names=["s1", "s2", "set"])

    texts = docs.select(base.row_key(base.text_of()).alias("rid"), "text")
    rows = base.only_keys(texts, wanted.select("rid").distinct(), "rid").select("text")
    found = rows.mapInArrow(of, "s1 long, s2 long, set array<long>").join(wanted.select("c", "n_shingles", "s1", "s2"), ["s1", "s2"])
    return base.keep(found.select("c", F.col("n_shingles").alias("n"), "set").dropDuplicates(["c"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; b's set goes to each a that it is compared with."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, np.zeros(0, np.int64)
        for batch in batches:
            a, b = [], []
            for u, c, s in zip(batch.column("unit").to_pylist(), batch.column("c").to_pylist(), arrays(batch.column("set")), strict=True):
                if u != unit:  # its own set comes first
                    unit, own = u, s
                elif len(own):
                    at = np.searchsorted(own, s)
                    common = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == s))
                    if 100 * common >= percent * (len(own) + len(s) - common):
                        a.append(unit)
                        b.append(c)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    needed = pairs.select(F.col("a").alias("unit"), F.col("b").alias("c")).unionByName(pairs.select(F.col("a").alias("unit"), F.col("a").alias("c")).distinct())
    rows = needed.join(sets, "c").select("unit", (F.col("c") != F.col("unit")).alias("other"), "c", "set")
    return rows.repartition("unit").sortWithinPartitions("unit", "other", "c").select("unit", "c", "set").mapInArrow(linked, "a long, b long")


def across(members: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(a, b): links between different roots of a cluster, exact; members has cluster, c, root.

    Classes outside the cluster's main root are held against all of the cluster. Sizes are cut into
    bands that a link spans one step of at most, so a class meets three bands, in blocks. A unit's
    second side is an inverted index; its first side streams past it. Of the links of a class to one
    root, one in each unit is given.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, waiting, index = None, [], None
        for batch in batches:
            a, b = [], []
            for u, outside, c, root, s in zip(*(batch.column(x).to_pylist() for x in ("unit", "outside", "c", "root")), arrays(batch.column("set")), strict=True):
                if u != unit:
                    unit, waiting, index = u, [], None
                if not outside:  # these come first
                    waiting.append((c, root, s))
                    continue
                if not waiting:
                    continue
                if index is None:
                    sizes = np.array([len(x) for _, _, x in waiting])
                    values = np.concatenate([x for _, _, x in waiting])
                    order = np.argsort(values, kind="stable")
                    index = values[order], np.repeat(np.arange(len(waiting)), sizes)[order], sizes, np.array([r for _, r, _ in waiting], np.int64)
                values, owners, sizes, roots = index
                low = np.searchsorted(values, s, "left")
                n = np.searchsorted(values, s, "right") - low
                at = np.arange(int(n.sum())) + np.repeat(low - (np.cumsum(n) - n), n)
                common = np.bincount(owners[at], minlength=len(sizes))
                near = np.flatnonzero((100 * common >= percent * (len(s) + sizes - common)) & (roots != root))
                for i in near[np.unique(roots[near], return_index=True)[1]].tolist():
                    a.append(c)
                    b.append(waiting[i][0])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = members.join(sets.select("c", "n"), "c").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9))
    rows = base.keep(rows, "banded")
    sizes = rows.groupBy("cluster", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("k", "root")).alias("x")).select("cluster", F.col("x.root").alias("main"))
    rows = rows.join(main, "cluster").withColumn("outside", F.col("root") != F.col("main"))
    parts = F.greatest(F.ceil(F.sum("n") / block), F.least(F.lit(SPLIT), F.ceil(F.sum("n") / SPLIT_SHINGLES)))
    blocks = lambda df, name: df.groupBy("cluster", "y").agg(parts.alias(name))
    reach = rows.where("outside").withColumn("y", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    units = base.keep(blocks(reach, "xs").join(blocks(rows.withColumnRenamed("band", "y"), "ys"), ["cluster", "y"]), "units")
    own = lambda n: F.pmod(F.xxhash64("c"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    first = reach.join(units, ["cluster", "y"]).select("cluster", "y", own(F.col("xs")).alias("i"), every("ys").alias("j"), F.lit(True).alias("outside"), "c", "root")
    second = rows.withColumnRenamed("band", "y").join(units, ["cluster", "y"]).select("cluster", "y", every("xs").alias("i"), own(F.col("ys")).alias("j"), F.lit(False).alias("outside"), "c", "root")
    dealt = base.keep(first.unionByName(second).select(F.xxhash64("cluster", "y", "i", "j").alias("unit"), "outside", "c", "root"), "dealt")
    dealt = dealt.join(sets.select("c", "set"), "c").repartition("unit").sortWithinPartitions("unit", "outside")
    return dealt.select("unit", "outside", "c", "root", "set").mapInArrow(compared, "a long, b long").distinct()
