"""Prefix trie of conversations (operator 12).

1. Turns are numbered, conversations rebuilt, and a polynomial fingerprint rolls along each one: a numpy scan
   over sorted rows (scans.py). Conversations with one fingerprint at one depth are a candidate node.
2. Every turn of a candidate's members is held against that of its representative, the member of the
   smallest id, and so is the parent. Equal turns are counted together before they are shuffled, so a
   node that many pass costs a row a task. Members that differ are split off, from that depth on, until
   none does.
3. Parents roll up their subtrees without a pass for each level: a node's values are those of the
   conversation that owns it, its smallest member; a conversation owns its path from some depth on.
   So a subtree's sum is that, over its members, of what each one owns from the node's depth on, which
   is a running sum along conversations from their last turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base
from packlens.llm.scans import PRIME, scanned

#: Conversations share their base's first turns in blocks of ids; at most BORROWED - 1 of them.
BLOCK, BORROWED = 20, 4
#: Ids in one piece of a node's list.
PIECE = 4096
NODE = ["depth", "fp", "x"]


def borrowed(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % BORROWED


def base_of(conv: Column) -> Column:
    return conv - conv % BLOCK


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, at, role, text) in the order (part, at) of the rebuilt conversations, and all conv_ids."""
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n)
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).where("conv_id is not null")
    turns = base.keep(scanned(turns, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]), "turns")
    convs = base.keep(turns.select("conv_id").distinct(), "convs")
    heads = turns.where((F.col("pos") < BORROWED - 1) & (F.col("conv_id") % BLOCK == 0)).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    given = convs.withColumn("base", base_of(F.col("conv_id"))).join(heads, "base").where(F.col("pos") < borrowed(F.col("conv_id")))
    own = turns.where(F.col("pos") >= borrowed(F.col("conv_id")))
    row = lambda df, i: df.select("conv_id", F.lit(i).alias("origin"), F.col("pos").alias("at"), "role", "text")
    return row(given, 0).unionByName(row(own, 1)), convs


def placed_turns(turns: DataFrame, bits: int) -> DataFrame:
    """conv_id, depth, fp and pfp (fingerprints with and without this turn), x and px (splits of collisions so far), role, text."""
    t = F.xxhash64("role", "text")
    lanes = turns.withColumns({"fa": F.pmod(t, F.lit(PRIME)), "fb": F.pmod(F.shiftrightunsigned(t, 31), F.lit(PRIME))})
    rows = scanned(lanes, "conv_id", [F.col("origin"), F.col("at")], fingerprint=True)
    fp = lambda n: (F.shiftleft(n + "a", 31) + F.col(n + "b")).bitwiseAND(F.lit((1 << bits) - 1))
    first = F.col("pos") == 0
    return base.keep(rows.select("conv_id", (F.col("pos") + 1).alias("depth"), fp("f").alias("fp"), F.when(first, F.lit(0)).otherwise(fp("g")).cast("long").alias("pfp"), F.lit(0).alias("x"), F.lit(0).alias("px"), "role", "text"), "placed")


def verified_nodes(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (NODE, pfp, px, conv_id, n_convs, n_words) whose members' turns are all equal, and placed with its final x, px."""
    while True:
        turn = ["pfp", "px", "role", "text"]
        contents = placed.groupBy(*NODE, *turn).agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).select(*NODE, "pfp", "px", "n", "conv_id", base.n_words(F.col("text")).alias("n_words"))
        first = [F.min_by(c, "conv_id").alias(c) for c in ("pfp", "px", "n_words")]
        nodes = base.keep(contents.groupBy(*NODE).agg(F.count("*").alias("kinds"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *first), "nodes")
        unlike = nodes.where("kinds > 1").select(*NODE, F.col("conv_id").alias("rep"))
        if unlike.isEmpty():
            return nodes.drop("kinds"), placed
        inside = placed.join(unlike, NODE)
        like = inside.where("conv_id = rep").select(*NODE, *[F.col(c).alias(f"rep_{c}") for c in turn])
        differs = ~(F.col("pfp").eqNullSafe(F.col("rep_pfp")) & (F.col("px") == F.col("rep_px")) & (F.col("role") == F.col("rep_role")) & (F.col("text") == F.col("rep_text")))
        off = base.keep(inside.join(like, NODE).where(differs).groupBy("conv_id").agg(F.min("depth").alias("since")), "split")
        later = lambda depth: F.coalesce((depth >= F.col("since")).cast("int"), F.lit(0))
        moved = placed.join(off, "conv_id", "left").withColumns({"x": F.col("x") + later(F.col("depth")), "px": F.col("px") + later(F.col("depth") - 1)})
        placed = base.keep(moved.drop("since"), "placed")


def digests(ends: DataFrame) -> DataFrame:
    """(NODE, ends_sha256) of ends (NODE, conv_id). Ids are sorted and joined to pieces in ranges; a node's digest reads its pieces in order."""

    def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, list[int]]:
        keys = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in NODE])
        at = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        return keys, [0, *at.tolist(), keys.shape[1]] if keys.shape[1] else [0]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            keys, at = runs(batch)
            ids = batch.column("conv_id").to_pylist()
            cuts = [(a, b) for i, j in zip(at[:-1], at[1:], strict=True) for a, b in zip(range(i, j, PIECE), [*range(i + PIECE, j, PIECE), j], strict=True)]
            first = keys[:, [a for a, _ in cuts]]
            seqs = np.arange(seq, seq + len(cuts))
            seq += len(cuts)
            yield pa.record_batch([pa.array(first[0]), pa.array(first[1]), pa.array(first[2].astype(np.int32)), pa.array(np.full(len(cuts), part, np.int32)), pa.array(seqs), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts], pa.string())], names=[*NODE, "part", "seq", "piece"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        empty = lambda out: pa.record_batch([pa.array([k[0] for k, _ in out], pa.int64()), pa.array([k[1] for k, _ in out], pa.int64()), pa.array([k[2] for k, _ in out], pa.int32()), pa.array([d for _, d in out], pa.string())], names=[*NODE, "ends_sha256"])
        for batch in batches:
            out = []
            for *key, piece in zip(*(batch.column(n).to_pylist() for n in (*NODE, "piece")), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            yield empty(out)
        yield empty([(now, digest.hexdigest())] if now is not None else [])

    key = "depth long, fp long, x int"
    cut = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pieces, f"{key}, part int, seq long, piece string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq").select(*NODE, "piece").mapInArrow(hashed, f"{key}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int = 62) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns are ordered by turn (null first), equal ones by role and text; repeated rows
    are turns of their own. Its first h turns, h being its id's crc32 modulo 4, are replaced by those of
    the first conversation of its block of 20 ids (none where that is absent). Null roles and texts are
    empty; rows without a conv_id belong to no conversation and are left out. Texts and conversations
    may be of any length. An empty table has no node, not even a root; other columns are ignored.
    bits: of the fingerprints; collisions are split, so fewer bits cost passes, not results.
    """
    turns, convs = rebuilt(conversations)
    nodes, placed = verified_nodes(placed_turns(turns, bits))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("x"), "conv_id", "n_convs", F.lit(None).cast("long").alias("pfp"), F.lit(None).cast("int").alias("px"), F.lit(0).cast("long").alias("n_words"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pfp").alias("fp"), F.col("px").alias("x")).agg(F.count("*").alias("n_children"))
    nodes = base.keep(nodes.unionByName(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "all_nodes")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_words")
    owned = lambda value, name: F.when(F.col("conv_id") == F.col("owner"), value).otherwise(F.lit(0)).alias(name)
    values = placed.select("conv_id", *NODE).join(nodes.withColumnRenamed("conv_id", "owner"), NODE).select("conv_id", *NODE, owned(leaf, "n_leaves"), owned(saved, "saved_tokens"))
    paths = base.keep(scanned(values, "conv_id", [F.col("depth").desc()], ("n_leaves", "saved_tokens")), "paths")
    totals = paths.groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    top = nodes.agg(F.sum(leaf).alias("n_leaves"), F.sum(saved).alias("saved_tokens")).select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("x"), "n_leaves", "saved_tokens")
    turnless = convs.join(paths.select("conv_id").distinct(), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), F.lit(0).alias("x"), "conv_id")
    ends = digests(base.keep(paths.where("pos = 0").select(*NODE, "conv_id").unionByName(turnless), "ends"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("pfp"), F.col("x").alias("px"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals.unionByName(top), NODE).join(ends, NODE, "left").join(parents, ["depth", "pfp", "px"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Prefixes as lists, subtrees by comparing lists: for tables of a few thousand turns.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY p) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, ts, conv_id - conv_id % 20 AS b, (xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT)),
  lambda a, s: list_reduce(list_prepend(xor(a, s), list_transform(range(8), lambda i: i::UBIGINT)), lambda c, i: xor(c >> 1, 3988292384::UBIGINT * (c & 1))))) % 4)::BIGINT AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(list_slice(x.ts, 1, h.h), []), list_slice(h.ts, h.h + 1, len(h.ts))) AS ts FROM h LEFT JOIN o x ON x.conv_id = h.b),
m AS (SELECT conv_id, d, list_slice(ts, 1, d) AS k, len(ts) = d AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM c)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(list_extract(k, d).t, '[^\x20\x09-\x0D]+')) END AS w FROM m GROUP BY k, d),
f AS (SELECT a.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM n z WHERE z.d = a.d + 1 AND list_slice(z.k, 1, a.d) = a.k) AS n_children FROM n a LEFT JOIN n p ON p.d = a.d - 1 AND p.k = list_slice(a.k, 1, a.d - 1))
SELECT a.conv_id, a.d AS depth, a.parent_conv_id, a.n_convs, a.n_children, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((u.n_convs - 1) * u.w)::BIGINT AS saved_tokens, sha256(a.e) AS ends_sha256
FROM f a JOIN f u ON u.d >= a.d AND list_slice(u.k, 1, a.d) = a.k GROUP BY a.k, a.conv_id, a.d, a.parent_conv_id, a.n_convs, a.n_children, a.e
"""
