"""Exact Jaccard join of documents' word n-grams by a grouped prefix join (operator 11).

1. Texts with equal shingle sets are one class. Two sets at the similarity miss few of each other's
   shingles, so among each one's smallest hashes, a fifth and a little more, several are common. Classes
   whose smallest hashes are not met often enough in other classes have no partner and leave.
2. Shingles of the classes left are ordered by rising frequency. Shingles of one class only match
   nothing: a class keeps those of its prefix that others have too.
3. Classes with the same prefix and size are one group. Only groups are listed under prefix shingles;
   pairs of groups whose sizes or common shingles can't reach the similarity are filtered.
4. Pairs of groups are expanded to members and decided by whole sets. A short list gives all its pairs;
   a long list, or a large group, is salted into small chains.
5. Links make components. Where a long list or large group is then in several components, its members
   outside the main component are held against all others, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, shinglesets
from packlens.llm.components import components

#: Percent of the union that links two sets in the registered query.
PERCENT = 80
#: A list with at most SHORT classes gives all pairs; others are salted into chains of about CHAIN.
SHORT, CHAIN = 4, 16
#: One more shared shingle is asked for in the first filter for so many shingles of a set.
STEP = 20


def first_prefix(n: int, percent: int) -> int:
    """How many of the smallest hashes of n a class is listed under in the first filter."""
    return min(n, n - shinglesets.least_overlap(n, percent) + 1 + n // STEP)


def class_rows(docs: DataFrame, percent: int, width: int) -> DataFrame:
    """doc_id, rid, n_shingles, s1, s2 (128 bits of the set), low (its smallest hashes) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shinglesets.row_sets(batch, width))
            ids = np.frombuffer(b"".join(shinglesets.set_id(s) for s in sets), np.int64).reshape(-1, 2)
            low = shinglesets.lists([s[: first_prefix(len(s), percent)] for s in sets])
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), low], names=["doc_id", "rid", "n_shingles", "s1", "s2", "low"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.row_key(base.text_of()).alias("rid"), "text")
    return rows.mapInArrow(of, "doc_id long, rid long, n_shingles long, s1 long, s2 long, low array<long>")


def with_partners(classes: DataFrame, percent: int) -> DataFrame:
    """Classes that have as many of their smallest hashes in common with others as any partner must have.

    A pair shares 1 + m // STEP of the two first prefixes, m the smaller size, which is `percent` of the other at least.
    """
    entries = classes.select("c", F.col("n_shingles").alias("n"), F.explode("low").alias("v"))
    lists = entries.groupBy("v").agg(F.count("*").alias("df"), F.min("n").alias("low"), F.max("n").alias("high"))
    shared = base.keep(lists.where((F.col("df") > 2) | ((F.col("df") == 2) & (100 * F.col("low") >= percent * F.col("high")))).select("v"), "shared")
    need = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / STEP)
    found = entries.join(shared, "v").groupBy("c", "n").agg(F.count("*").alias("k")).where(F.col("k") >= need)
    return base.keep(found.select("c").join(classes.drop("low"), "c"), "with_partners")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(c, n, s, prefix): the shingles of a class's prefix that other classes have, rarest first; s of all its shingles are shared.

    Classes with too few shared shingles for any link are left out.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []  # the class being read

        def ended() -> Iterator[tuple[int, int, int, np.ndarray]]:
            if now is not None:
                values = np.concatenate(parts)
                if len(values) >= (need := shinglesets.least_overlap(now[1], percent)):
                    yield *now, len(values), values[: len(values) - need + 1]

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(3)] + [shinglesets.lists([x[3] for x in out])], names=["c", "n", "s", "prefix"])

        for batch in batches:
            out = []
            c, n, v = (batch.column(x).to_numpy() for x in ("c", "n", "v"))
            at = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
            for a, b in zip(at[:-1], at[1:], strict=True):
                if a < b:
                    if now is None or now[0] != c[a]:
                        out += ended()
                        now, parts = (int(c[a]), int(n[a])), []
                    parts.append(v[a:b])
            yield batch_of(out)
        yield batch_of(list(ended()))

    tokens = sets.select("c", "n", F.explode("set").alias("v"))
    shared = base.keep(tokens.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    ranked = tokens.join(shared, "v").repartition("c").sortWithinPartitions("c", "df", "v")
    return ranked.select("c", "n", "v").mapInArrow(of, "c long, n long, s long, prefix array<long>")


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes n and shared shingles s of two structs allow the similarity."""
    return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & ((100 + percent) * F.least(a["s"], b["s"]) >= percent * (a["n"] + b["n"]))


def all_pairs(members: str, percent: int) -> Column:
    """Pairs (a, b) of an array of structs (c, n, s) that may link."""
    pair = lambda a, b: F.struct(a["c"].alias("a"), b["c"].alias("b"))
    return F.flatten(F.transform(members, lambda a: F.transform(F.filter(members, lambda b: (b["c"] > a["c"]) & may_link(a, b, percent)), lambda b: pair(a, b))))


def chain(members: str, percent: int) -> Column:
    """Pairs of neighbours by size in an array of structs (n, s, c) that may link."""
    ordered = F.array_sort(F.col(members))
    pairs = F.zip_with(F.slice(ordered, F.lit(1), F.greatest(F.size(members) - 1, F.lit(0))), F.slice(ordered, F.lit(2), F.greatest(F.size(members) - 1, F.lit(0))), lambda a, b: F.struct(F.least(a["c"], b["c"]).alias("a"), F.greatest(a["c"], b["c"]).alias("b"), may_link(a, b, percent).alias("may")))
    return F.transform(F.filter(pairs, lambda p: p["may"]), lambda p: F.struct(p["a"], p["b"]))


def candidate_pairs(groups: DataFrame, members: DataFrame, listed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes: all of short lists and small groups, chains of the others; at most a few a listed class."""
    item = F.struct("n", "s", "c").alias("x")
    salted = lambda df, keys, size, salt: df.withColumn("salt", F.pmod(F.xxhash64("c", salt), F.ceil(F.col(size) / CHAIN))).groupBy(*keys, "salt").agg(F.collect_list(item).alias("xs"))
    pairs_of = lambda df, pairs: df.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
    short = listed.where(F.col("classes") <= SHORT).select("v", "g").join(members, "g").groupBy("v").agg(F.collect_list(item).alias("xs"))
    long = salted(listed.where(F.col("classes") > SHORT).withColumn("c", F.col("g")), ["v"], "lists", F.col("v"))
    inside = members.join(groups.where("size > 1").select("g", "size"), "g")
    small = inside.where(F.col("size") <= SHORT).groupBy("g").agg(F.collect_list(item).alias("xs"))
    large = salted(inside.where(F.col("size") > SHORT).withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))), ["g", "turn"], "size", F.col("turn"))
    found = pairs_of(short, all_pairs("xs", percent)).unionByName(pairs_of(long, chain("xs", percent))).unionByName(pairs_of(small, all_pairs("xs", percent))).unionByName(pairs_of(large, chain("xs", percent)))
    return base.keep(found.distinct(), "pairs")


def unsettled(groups: DataFrame, members: DataFrame, listed: DataFrame, roots: DataFrame) -> DataFrame:
    """(cluster, c, root): members of long lists and large groups that hold several components, clustered by these."""
    at = base.keep(members.select("g", "c").join(roots, F.col("c") == F.col("node"), "left").select("g", "c", F.coalesce("root", "c").alias("root")), "placed")
    span = at.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # a group is a list of its own; lists and groups are told apart by hashes, which may only join clusters that need not be
    places = listed.where(F.col("classes") > SHORT).select("v", "g").unionByName(groups.where(F.col("size") > SHORT).select(F.xxhash64("g").alias("v"), "g"))
    placed = places.join(span, "g")
    split = base.keep(placed.groupBy("v").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("v"), "split")
    spread = base.keep(places.join(split, "v").join(at.select("g", "root").distinct(), "g").select("v", "root").distinct(), "spread")
    joined = components(spread.select(F.col("root").alias("a"), F.col("v").alias("b")))
    clusters = spread.select("root").distinct().join(joined.select("node", F.col("root").alias("cluster")), F.col("root") == F.col("node"), "left").select("root", F.coalesce("cluster", "root").alias("cluster"))
    inside = places.join(split, "v").select("g").distinct()
    return base.keep(at.join(inside, "g").select("c", "root").join(clusters, "root").select("cluster", "c", "root"), "unsettled")


def ngram_join(docs: DataFrame, percent: int = PERCENT, width: int = base.SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text).

    Words are lower-cased (A-Z). Two rows link when 100 * shared >= percent * union of their sets of
    shingles; component_id is the smallest doc_id reachable. A text with fewer words than the width is
    one shingle; without words or with a null text it has none and is linked with nothing. Null ids
    are carried and smallest only where all are null. Rows repeated in full, or with one id and
    different texts, are rows like others; ties have no effect. Whole texts of any length count. An
    empty table gives no rows; other columns are ignored. Shingles are compared by 64-bit hashes,
    whole sets of copies by 128 bits.
    """
    wide = base.keep(class_rows(docs, percent, width), "wide")
    rows = base.keep(wide.drop("low"), "rows")
    classes = wide.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min("rid").alias("rid"), F.first("n_shingles").alias("n_shingles"), F.first("low").alias("low"))
    listed = base.keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    base.forget(wide)
    classes = base.keep(listed.drop("low"), "narrow")
    wanted = with_partners(listed, percent)
    base.forget(listed)
    sets = shinglesets.stored_sets(docs, wanted, width)
    kept = base.keep(prefixes(sets, percent), "prefixes")
    groups = base.keep(kept.groupBy("n", "s", "prefix").agg(F.min("c").alias("g"), F.count("*").alias("size")), "groups")
    members = base.keep(kept.join(groups.select("n", "s", "prefix", "g"), ["n", "s", "prefix"]).select("g", "c", "n", "s"), "members")
    entries = groups.select("g", "size", F.explode("prefix").alias("v"))
    lists = base.keep(entries.groupBy("v").agg(F.count("*").alias("lists"), F.sum("size").alias("classes")).where("lists > 1"), "lists")
    listed = base.keep(groups.select("g", "n", "s", F.explode("prefix").alias("v")).join(lists, "v"), "listed")
    links = base.keep(shinglesets.verified(candidate_pairs(groups, members, listed.select("v", "g", "n", "s", "lists", "classes"), percent), sets, percent), "links")
    roots = components(links)
    rest = unsettled(groups, members, listed, roots)
    if not rest.isEmpty():
        more = base.keep(shinglesets.across(rest, sets, percent), "more_links")
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    placed = classes.select("s1", "s2", "doc_id", "c").join(roots, F.col("c") == F.col("node"), "left").select("s1", "s2", "doc_id", F.coalesce("root", "c").alias("group"))
    labels = base.keep(placed.join(placed.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group").select("s1", "s2", "component_id"), "labels")
    df = rows.select("doc_id", "n_shingles", "s1", "s2")
    linked = df.where("n_shingles > 0").join(labels, ["s1", "s2"], "left").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(df.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(base.documents(spark, sf_dir))


#: Links by a join on shingles, components by reachability: for tables of a few thousand documents.
OP11_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(ws, i, i + 4), ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.rid <> y.rid GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON a = p.rid JOIN n q ON b = q.rid WHERE 100 * c >= 80 * (p.n + q.n - c)),
r(rid, other) AS (SELECT rid, rid FROM d UNION SELECT r.rid, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT r.rid, min(o.doc_id) AS component_id FROM r JOIN d o ON r.other = o.rid GROUP BY r.rid)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""
