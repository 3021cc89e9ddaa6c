"""Line dedup across documents (operator 9), in DataFrame functions only.

Lines become hashes once. Counts of documents per line key are combined before they are shuffled. Only
occurrences of keys that repeat are then range-partitioned by (key hash, document) and sorted by
position within, which cuts a key with very many occurrences over as many partitions as it fills; first
occurrences are read off the sorted stream. Each document gets back a compressed bitmap of its lines,
never text, and keeps what that says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.llm import base

MIN_CODE_POINTS, MIN_DOCS = 1, 10
#: What line keys are stripped of.
STRIP = " \t\n\x0b\x0c\r"


def line_keys(docs: DataFrame, min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """rid, pos, h1, h2 of every line with a key; a key is the line stripped and with A-Z lower-cased."""
    trimmed = F.filter(
        F.transform(F.split(base.ascii_lower(F.col("text")), "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "").alias("key"))),
        lambda x: F.length(x["key"]) >= min_code_points,
    )
    rows = docs.select("rid", F.explode(trimmed).alias("line"))
    return rows.select("rid", F.col("line.pos").alias("pos"), F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(1), "line.key").alias("h2"))


def keyed(docs: DataFrame) -> DataFrame:
    text = base.text_of()
    return docs.select("doc_id", base.row_key(text).alias("rid"), text.alias("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_code_points: int = MIN_CODE_POINTS, keep_first: bool = False) -> DataFrame:
    """rid and runs for each document that loses a line.

    runs is the bitmap of kept and dropped lines, compressed: the positions where it changes, so that lines
    from an even element to before the next are dropped. With keep_first, the first line by (rid,
    position) of each key stays.
    """
    lines = base.keep(line_keys(keyed(docs).dropDuplicates(["rid"]) if keep_first else keyed(docs), min_code_points), "line_keys")
    first = F.min("rid").alias("first")
    frequent = lines.groupBy("h1", "h2", "rid").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), first).where(F.col("n") >= min_docs).drop("n")
    frequent = base.keep(frequent, "frequent")  # so that the join shuffles both sides for itself and a hot key can be split
    # ranges of (key, document) cut a frequent key over as many tasks as it fills; a document's occurrences stay together, in order
    stream = lines.join(frequent, ["h1", "h2"]).repartitionByRange("h1", "h2", "rid").sortWithinPartitions("h1", "h2", "rid", "pos")
    if keep_first:
        before = F.lag("pos").over(Window.partitionBy("h1", "h2", "rid").orderBy("pos"))  # within the ranges, over the sorted stream
        stream = stream.withColumn("before", before).where(F.col("before").isNotNull() | (F.col("rid") != F.col("first")))
    by_doc = stream.groupBy("rid").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return by_doc.select("rid", run_edges(F.col("dropped")).alias("runs"))


def run_edges(dropped: Column) -> Column:
    """Sorted positions as first and one past the last of each run."""
    opens = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))
    ends = F.transform(F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1)), lambda p: p + 1)
    return F.flatten(F.transform(F.arrays_zip(opens.alias("a"), ends.alias("b")), lambda x: F.array(x["a"], x["b"])))


def without_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text rid of its dropped lines, and n_lines (before) and n_dropped.

    A null text is one empty line, which has no key: it becomes an empty text.
    """
    marks = bitmaps.select(F.col("rid").alias("__rid"), F.col("runs").alias("__runs"))
    text = base.text_of()
    df = docs.withColumn("__text", text).withColumn("__rid", base.row_key(text)).join(marks, "__rid", "left")
    df = df.withColumn("__lines", F.split("__text", "\n"))
    runs, kept_runs = F.col("__runs"), F.sequence(F.lit(0), (F.size("__runs") / 2).cast("int"))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(runs, 2 * i - 1))
    end = lambda i: F.coalesce(F.get(runs, 2 * i), F.size("__lines"))
    kept = base.let(F.col("__lines"), lambda ls: F.flatten(F.transform(kept_runs, lambda i: F.slice(ls, start(i) + 1, end(i) - start(i)))))
    df = df.withColumn("text", F.when(runs.isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")))
    lost = F.aggregate(runs, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")), lambda a, p: F.struct((a["n"] + a["sign"] * p).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])
    df = df.withColumn("n_lines", F.size("__lines").cast("long")).withColumn("n_dropped", F.coalesce(lost, F.lit(0)).cast("long"))
    return df.drop("__rid", "__runs", "__text", "__lines")


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, min_code_points: int = MIN_CODE_POINTS, keep_first: bool = False) -> DataFrame:
    """docs without the lines whose key is in at least min_docs documents, with n_lines and n_dropped.

    Nulls: a null text is one empty line; a null doc_id is an id like any other. Rows repeated in
    full count as one document and all lose the same lines. An empty table gives no rows. Columns
    other than doc_id and text pass through, except n_lines and n_dropped, which are replaced.
    Keys are compared by 128 bits of hash.
    """
    return without_lines(docs, keep_bitmaps(docs, min_docs, min_code_points, keep_first))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = line_dedup(base.documents(spark, sf_dir).select("doc_id", "text"))
    return df.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT rid, doc_id, t, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM (SELECT *, string_split(t, chr(10)) AS ls FROM d)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT (doc_id, t)) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
