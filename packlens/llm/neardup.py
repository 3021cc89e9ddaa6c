"""Near-duplicates by bottom-k MinHash sketches from one hash function (operator 1).

1. Texts with equal shingle sets are one class. A class keeps the K smallest shingle hashes.
2. Inverted lists of the INDEXED smallest retained values. A pair at the similarity shares at least
   NEED of them (but for a chance under 1e-7), so a class is only listed under its rarest values, as
   many as any partner must meet one of.
3. A short list gives all its pairs. A long list is salted into small groups that give stars only.
4. The union sketch estimates each pair's similarity and drops pairs that can't reach it; the whole
   shingle sets decide the rest.
5. Links make components. A long list whose classes are then in several components is the one place
   where a link can have been missed: there classes outside the main component are held against those
   of a like size by an inverted index of whole sets, which are written once (shinglesets.py).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, npwords, shinglesets
from packlens.llm.components import components

#: Retained values; those in inverted lists; a list of at most SHORT classes gives all pairs, others stars of about GROUP.
K, INDEXED, SHORT, GROUP = 64, 32, 4, 16


def least_shared(n: int, similarity: float) -> int:
    """The fewest of n common draws, each shared with the similarity's chance, that fall short with a chance under 1e-7."""
    total = 0.0
    for x in range(n + 1):
        total += math.comb(n, x) * similarity**x * (1 - similarity) ** (n - x)
        if total > 1e-7:
            return max(x, 1)
    return n


def sketches(docs: DataFrame, width: int = base.SHINGLE_WORDS) -> DataFrame:
    """doc_id, rid and rid2 (128 bits of the row), n_shingles, s1, s2 (128 bits of the whole set), sketch (K smallest values, little-endian)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = npwords.text_bytes(batch.column("text"))
            n, ids, kept = [], [], []
            for _, _, firsts, h in npwords.rows(offsets, data):
                for s in npwords.shingles(firsts, h, width):
                    s = np.unique(s)
                    n.append(len(s))
                    ids.append(shinglesets.set_id(np.roll(s, -int(np.searchsorted(s, np.uint64(1 << 63))))))  # in the order of signed numbers
                    kept.append(s[:K].tobytes())
            pair = np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("rid"), batch.column("rid2"), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(kept, pa.binary())],
                names=["doc_id", "rid", "rid2", "n_shingles", "s1", "s2", "sketch"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.row_key(base.text_of()).alias("rid"), base.row_key2(base.text_of()).alias("rid2"), "text")
    return rows.mapInArrow(of, "doc_id long, rid long, rid2 long, n_shingles long, s1 long, s2 long, sketch binary")


def lists(classes: DataFrame, similarity: float) -> DataFrame:
    """(v, df, c): classes under their rarest retained values, values of one class left out."""
    need = least_shared(INDEXED, similarity)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [np.frombuffer(x.as_buffer(), np.int64)[:INDEXED] for x in batch.column("sketch")]
            sizes = [len(x) for x in kept]
            repeat = lambda name, sizes=sizes, batch=batch: pa.array(np.repeat(batch.column(name).to_numpy(), sizes))
            yield pa.record_batch([pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])), repeat("c"), repeat("n_shingles")], names=["v", "c", "n"])

    entries = classes.where("n_shingles > 0").select("c", "n_shingles", "sketch").mapInArrow(values, "v long, c long, n long")
    shared = entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    shared = base.keep(shared, "shared")  # so that the join shuffles both sides for itself and a hot value can be split
    size = F.least(F.col("n"), F.lit(INDEXED))
    meet = F.least(F.ceil(similarity * F.col("n")), F.lit(need))
    by_class = entries.join(shared, "v").groupBy("c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("common"))
    rarest = F.greatest(F.lit(0), (size - meet + 1) - (size - F.size("common"))).cast("int")
    return by_class.select("c", F.explode(F.slice("common", F.lit(1), rarest)).alias("x")).select("x.v", "x.df", "c")


def first_pairs(listed: DataFrame) -> DataFrame:
    """All pairs of short lists, and stars within salted groups of long ones: at most SHORT or 1 a listed class."""
    groups = F.when(F.col("df") <= SHORT, F.lit(1)).otherwise(F.ceil(F.col("df") / GROUP))
    salted = listed.withColumn("salt", F.pmod(F.xxhash64("c", "v"), groups)).groupBy("v", "df", "salt").agg(F.array_sort(F.collect_list("c")).alias("cs"))
    others = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    star = F.transform(F.slice("cs", F.lit(2), F.greatest(F.size("cs") - 1, F.lit(0))), lambda b: F.struct(F.element_at("cs", 1).alias("a"), b.alias("b")))
    pairs = salted.where(F.size("cs") > 1).select(F.explode(F.when(F.col("df") <= SHORT, others).otherwise(star)).alias("p"))
    return pairs.select("p.a", "p.b").distinct()


def clusters(listed: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, c, root): classes of long lists that hold several components, clustered by shared lists."""
    placed = listed.where(F.col("df") > SHORT).join(roots, F.col("c") == F.col("node"), "left").select("v", "c", F.coalesce("root", "c").alias("root"))
    split = base.keep(placed.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("v"), "split")
    members = base.keep(placed.join(split, "v"), "members")
    joined = components(members.select(F.col("root").alias("a"), F.col("v").alias("b")).distinct())
    at = joined.select(F.col("node").alias("root"), F.col("root").alias("cluster"))
    return members.select("c", "root").distinct().join(at, "root", "left").select(F.coalesce("cluster", "root").alias("cluster"), "c", "root")


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sizes and union sketches allow the similarity."""
    need = [0] + [least_shared(k, similarity) for k in range(1, K + 1)]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                same = both[1:] == both[:-1]
                # the union sketch is exact up to K values, or all where both sets are whole
                distinct = np.concatenate([[True], ~same]).cumsum()
                k = min(K, int(distinct[-1]))
                keep.append(int(np.count_nonzero(same & (distinct[1:] <= k))) >= need[k])
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(mask)

    x = classes.select(F.col("c").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
    y = classes.select(F.col("c").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("y"))
    near = pairs.join(x, "a").join(y, "b").where((F.least("n", "m") >= similarity * F.greatest("n", "m")))
    return near.select("a", "b", "x", "y").mapInArrow(close, "a long, b long")


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(rid, rid2, text) of docs, as far as can be told those that are needed."""
    texts = docs.select(base.row_key(base.text_of()).alias("rid"), base.row_key2(base.text_of()).alias("rid2"), "text")
    return base.only_keys(texts, base.keep(needed.select("rid").distinct(), "rids"), "rid")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the similarity; a text goes once to each class it is compared with."""
    percent = round(100 * similarity)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own, waiting = None, None, []
        for batch in batches:
            offsets, data = npwords.text_bytes(batch.column("text"))
            units, cs = batch.column("unit").to_pylist(), batch.column("c").to_pylist()
            a, b = [], []
            for i, _, firsts, h in npwords.rows(offsets, data):
                for k, s in enumerate(npwords.shingles(firsts, h, width), i):
                    s = np.unique(s)
                    if units[k] != unit:
                        unit, own, waiting = units[k], None, []
                    if cs[k] == unit:  # comes first
                        own = s
                    elif own is not None:
                        common = len(own) + len(s) - len(np.unique(np.concatenate([own, s])))
                        if 100 * common >= percent * (len(own) + len(s) - common):
                            a.append(unit)
                            b.append(cs[k])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    needed = pairs.select(F.col("a").alias("unit"), F.col("b").alias("c")).unionByName(pairs.select(F.col("a").alias("unit"), F.col("a").alias("c")).distinct())
    rows = base.keep(needed.join(classes.select("c", "rid", "rid2"), "c"), "needed")
    rows = rows.join(texts_of(docs, rows), ["rid", "rid2"]).select("unit", "c", (F.col("c") != F.col("unit")).alias("other"), "text")
    rows = rows.repartition("unit").sortWithinPartitions("unit", "other", "c")
    return rows.select("unit", "c", "text").mapInArrow(linked, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, similarity: float = base.SIMILARITY, width: int = base.SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, rid and rid2 (see base), group and group2 for every row of docs (doc_id, text).

    Words are lower-cased (A-Z). A text with fewer words than the width is one shingle; without words
    or with a null text it has none and is linked with nothing. component_id is the smallest doc_id
    linked, by however many steps. Null ids are carried and smallest only where all are null; kept
    compares null-safely. Rows repeated in full, or with one id and different texts, are rows like
    others. An empty table gives no rows; other columns are ignored. Shingles are compared by 64-bit
    hashes, whole sets and rows by 128 bits; a link between sketches is missed with a chance under 1e-7.
    """
    all_docs = base.keep(sketches(docs, width), "sketches")
    classes = all_docs.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("rid", "rid2")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = classes.select("s1", "s2", "doc_id", "row.*", "n_shingles", "sketch")
    # ids of the written rows: unlike a part of the set's hash, no two classes can share one
    classes = base.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    listed = base.keep(lists(classes, similarity), "lists")
    pairs = base.keep(estimated(first_pairs(listed), classes, similarity), "pairs")
    links = base.keep(verified(pairs, classes, docs, similarity, width), "links")
    roots = components(links)
    members = base.keep(clusters(listed, roots), "clustered")
    if not members.isEmpty():
        wanted = base.keep(classes.select("c", "n_shingles", "s1", "s2", "rid").join(members.select("c").distinct(), "c"), "wanted")
        more = base.keep(shinglesets.across(members, shinglesets.stored_sets(docs, wanted, width), round(100 * similarity)), "more_links")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = classes.select("s1", "s2", "doc_id", "c").join(roots, F.col("c") == F.col("node"), "left").select("s1", "s2", "doc_id", F.coalesce("root", "c").alias("group"))
    smallest = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    labels = base.keep(placed.join(smallest, "group").select("s1", "s2", "component_id", "group"), "labels")
    df = all_docs.select("doc_id", "n_shingles", "s1", "s2", "rid", "rid2")
    linked = df.where("n_shingles > 0").join(labels, ["s1", "s2"], "left").withColumn("group2", F.lit(None).cast("long"))
    alone = df.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "group": F.col("rid"), "group2": F.col("rid2")})
    names = ["doc_id", "n_shingles", "component_id", "rid", "rid2", "group", "group2"]
    both = linked.select(*names).unionByName(alone.select(*names))
    return both.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", *names[3:])


def representatives(docs: DataFrame, similarity: float = base.SIMILARITY, width: int = base.SHINGLE_WORDS) -> DataFrame:
    """One row of docs for each group of near-duplicates: that of the smallest id (null last), of equal ids any one.

    Texts without words are groups of their own, but rows repeated in full are one. Rows are told apart
    by 128 bits of id and text.
    """
    found = base.keep(near_duplicates(docs.select("doc_id", "text"), similarity, width), "found")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid", "rid2")
    chosen = base.keep(found.groupBy("group", "group2").agg(F.min(order).alias("x")).select(F.col("x.rid").alias("__rid"), F.col("x.rid2").alias("__rid2")).distinct(), "chosen")
    few = chosen.count() <= base.BROADCAST_KEYS
    rows = docs.withColumn("__rid", base.row_key(base.text_of())).withColumn("__rid2", base.row_key2(base.text_of()))
    rows = rows.join(F.broadcast(chosen) if few else chosen, ["__rid", "__rid2"], "left_semi")
    if not found.groupBy("rid", "rid2").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__rid", "__rid2"])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(base.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


#: Links by a join on shingles, components by reachability: for tables of a few thousand documents.
OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.rid JOIN n q ON b = q.rid WHERE 100 * c >= 75 * (p.n + q.n - c)),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON r.other = o.rid GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
