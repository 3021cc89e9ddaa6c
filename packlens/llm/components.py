"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.llm import base

#: A node with more than this part of a round's edges is hot; there can't be more such nodes than this.
HOT_SHARE = 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not its component's smallest; edges has long columns a, b.

    Each round hands every node's larger neighbours, then its smaller ones, to the smallest node in
    sight, and is written to the shared folder. It ends when what is left are stars: every node
    with one edge down, to a node that has none. That takes about log of the diameter.
    """
    stars = base.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"), "n")
        most = -(-both.count() // HOT_SHARE)
        large = with_least(stars, low, "v", most).select("u", F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, low, "u", most).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        stars = base.keep(small.where("u <> v").distinct(), "stars")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def with_least(edges: DataFrame, low: DataFrame, name: str, most: int) -> DataFrame:
    """edges with m, the smallest node in sight of node `name`, by low (name, m, n).

    Nodes with more than `most` of the edges are sent to all executors, at most HOT_SHARE of them by
    their count; their edges are dealt by the other end, so that a star's centre is no task of its own.
    """
    hot = F.broadcast(low.where(F.col("n") > most).select(name, F.col("m").alias("hot")))
    other = "u" if name == "v" else "v"
    dealt = edges.join(hot, name, "left").withColumn("k", F.when(F.col("hot").isNull(), F.col(name)).otherwise(F.xxhash64(other)))
    return dealt.join(low.select(F.col(name).alias("k"), "m"), "k", "left").select(*edges.columns, F.coalesce("hot", "m").alias("m"))


def are_stars(edges: DataFrame) -> bool:
    """Whether no node has two edges down and none is between others. Each edge says of its upper end
    that it has an edge down, and of its lower end that it has one up."""
    down = edges.select(F.col("u").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    up = edges.select(F.col("v").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    nodes = down.unionByName(up).groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return nodes.where("down > 1 or (down = 1 and up = 1)").isEmpty()
