"""Mixing sources to target weights by weighted fair queueing (operator 8), in DataFrame functions only.

Each source is a queue of its documents in shuffled order, passed through up to `epochs` times. A
document's virtual finish time is the source's words up to and including it divided by the source's
weight. All documents are range-sorted by that time and the mix is cut where its words reach the
budget. A queue that ends early leaves its share to the others, which is the resharing of targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.llm import base

WEIGHTS, SHARE_PERCENT, EPOCHS = (3, 1, 2), 150, 2
#: Queues are cut into this many blocks by the shuffle key and the mix into slots of virtual time; both
#: only fix how large a sort is. SLOTS_TO_CUT slots end where the budget's fluid limit is.
BLOCK_HEX, SLOTS_TO_CUT = 3, 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size in words, source as (unknown, name) without nulls, and the shuffle key."""
    text = base.text_of()
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    return docs.select("doc_id", base.n_words(text).alias("size"), F.col("source").isNull().alias("unknown"), F.coalesce("source", F.lit("")).alias("name"), key.alias("key"))


def weighted_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights given in turn to the sources by code point, the null source last. One row a source."""
    turn = (F.row_number().over(Window.orderBy("unknown", "name")) - 1) % len(weights)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Adds target and level to (unknown, name, source_size, weight): budget shared by weight, at most epochs * size.

    By rising cap per weight, a source is capped if the level over it and all later sources, with
    the earlier ones at their caps, reaches its own cap. The level is then that of the uncapped
    ones. Sums are integers, times 100, so that any engine divides the same numbers.
    """
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "unknown", "name")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * epochs
    df = sources.withColumn("__rest", share_percent * F.sum("source_size").over(Window.partitionBy()) - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0)))
    df = df.withColumn("__w", F.sum("weight").over(after)).withColumn("__capped", cap / F.col("weight") <= F.col("__rest") / (100 * F.col("__w")))
    open_ = ~F.col("__capped")
    df = df.withColumn("__num", F.max(F.when(open_, F.col("__rest"))).over(Window.partitionBy())).withColumn("__den", F.max(F.when(open_, F.col("__w"))).over(Window.partitionBy()))
    target = F.when(F.col("__capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("__num") / (100 * F.col("__den")))
    return df.select("unknown", "name", "source_size", "weight", target.alias("target"), (F.col("__num") / (100 * F.col("__den"))).alias("level"))


def fair_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source, source_size, target and taken for every row of docs.

    Nulls: a null text has size 0, a null source is the last source, a null doc_id is carried.
    Equal rows share a place in the queue and are taken or left together. An empty table gives no
    rows. Other columns are ignored. The queue of a large source is never in one task: its prefix
    sums are block sums plus a sort in each block, and the cut needs an exact sort of one slot only.
    """
    rows = base.keep(sized(docs), "sizes")
    block = F.substring("key", 1, BLOCK_HEX)
    queue = ["unknown", "name"]
    blocks = rows.groupBy(*queue, block.alias("block")).agg(F.sum("size").alias("block_size"))
    sources = targets(weighted_sources(blocks.groupBy(*queue).agg(F.sum("block_size").alias("source_size")), weights), share_percent, epochs)
    ahead = F.sum("block_size").over(Window.partitionBy(*queue).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("ahead", F.coalesce(ahead, F.lit(0))).drop("block_size").join(sources, queue)
    within = F.sum("size").over(Window.partitionBy(*queue, "block").orderBy("key"))
    df = rows.withColumn("block", block).join(blocks, [*queue, "block"]).withColumn("__upto", within + F.col("ahead"))
    df = base.keep(df.drop("block", "ahead"), "queues")

    def place(turn: int) -> Column:
        """Virtual finish time of the turn's pass, then what orders equal times."""
        time = (turn * F.col("source_size") + F.col("__upto")) / F.col("weight")
        return F.struct(time.alias("time"), F.col("unknown"), F.col("name"), F.lit(turn).alias("turn"), F.col("key"))

    def slot(at: Column) -> Column:
        return F.floor(F.least(at["time"] / F.col("level"), F.lit(4.0)) * SLOTS_TO_CUT)

    passes = df.where("size > 0").select("size", "level", F.explode(F.array(*map(place, range(epochs)))).alias("at"))
    passes = passes.select("size", "at", slot(F.col("at")).alias("slot"))
    budget = sources.agg(F.sum("source_size").alias("n")).select(F.col("n") * share_percent).scalar()
    slots = passes.groupBy("slot").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.orderBy("slot"))
    cut = slots.select("slot", (upto - F.col("n")).alias("before"), upto.alias("upto")).where(100 * F.col("upto") > budget).agg(F.min(F.struct("slot", "before")).alias("c"))
    cut_slot, cut_before = cut.select("c.slot").scalar(), cut.select("c.before").scalar()
    ordered = passes.where(F.col("slot") == cut_slot).withColumn("upto", F.sum("size").over(Window.orderBy("at")) + cut_before)
    last = ordered.where(100 * F.col("upto") <= budget).agg(F.max("at").alias("at")).scalar()

    def taken(turn: int) -> Column:
        at = place(turn)
        return F.coalesce((slot(at) < cut_slot) | ((slot(at) == cut_slot) & (at <= last)), cut_slot.isNull()).cast("long")

    copies = sum((taken(t) for t in range(1, epochs)), taken(0))
    source = F.when(~F.col("unknown"), F.col("name")).alias("source")
    return df.select("doc_id", "size", source, "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.when(F.col("size") > 0, F.col("size") * copies).otherwise(F.lit(0)).cast("long").alias("taken"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(base.documents(spark, sf_dir)).drop("source")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, source IS NULL AS unknown, coalesce(source, '') AS name,
        md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT unknown, name, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY unknown, name) - 1) % 3) + 1]::BIGINT AS weight FROM s),
r AS (SELECT *, 150 * (sum(source_size) OVER ())::BIGINT - 100 * coalesce((sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0) AS rest,
        (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS ws
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, unknown, name)),
c AS (SELECT *, (2 * source_size)::DOUBLE / weight <= rest::DOUBLE / (100 * ws) AS capped FROM r),
l AS (SELECT max(rest) AS num, max(ws) AS den FROM c WHERE NOT capped),
t AS (SELECT unknown, name, source_size, weight, CASE WHEN capped THEN (2 * source_size)::DOUBLE ELSE (weight * num)::DOUBLE / (100 * den) END AS target FROM c, l),
q AS (SELECT d.*, source_size, weight, target, (sum(size) OVER (PARTITION BY unknown, name ORDER BY key))::BIGINT AS upto FROM d JOIN t USING (unknown, name)),
p AS (SELECT doc_id, key, size, unknown, name, turn, (turn * source_size + upto)::DOUBLE / weight AS time FROM q, (VALUES (0), (1)) AS v(turn) WHERE size > 0),
o AS (SELECT *, sum(size) OVER (ORDER BY time, unknown, name, turn, key) AS total FROM p),
m AS (SELECT key, unknown, name, count(DISTINCT turn) AS turns FROM o WHERE 100 * total <= 150 * (SELECT sum(source_size) FROM t) GROUP BY ALL)
SELECT q.doc_id, q.size, q.source_size, coalesce(q.target, 0) AS target, (q.size * coalesce(m.turns, 0))::BIGINT AS taken
FROM q LEFT JOIN m ON q.key = m.key AND q.unknown = m.unknown AND q.name = m.name
"""
