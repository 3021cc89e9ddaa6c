"""Quality rules with verdicts on hosts (operator 7), in DataFrame functions only.

Rules are counted on each whole document. Failures are summed by host, each host's rate is shrunk
towards all hosts by an empirical beta prior (method of moments), and the verdict on the host is
joined back to its documents: a suspect host's documents may break no rule at all, others' may
break the advisory ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base

#: A word window that counts as repeated, and the limits of the base rules.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
#: Further rules. The first two reject a document on any host, the others on suspect hosts only.
MAX_SYMBOL_PERCENT, MAX_UPPER_PERCENT = 10, 50
MIN_WORD_CHARS, MAX_WORD_CHARS, MAX_DUP_LINE_PERCENT = 3, 10, 30
#: A host whose shrunk failure rate is at least this is suspect.
SUSPECT_RATE = 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of WINDOW words found at least twice in the text, each counted once.

    Windows are compared by a 64-bit hash within one text. Texts without a repeated window, nearly
    all, stop at the hash set of array_distinct; the others sort (hash, position) once.
    """

    def covered(marked: Column) -> Column:
        starts = F.sort_array(
            F.transform(
                F.filter(marked, lambda x, i: F.coalesce((i > 0) & (F.get(marked, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(marked, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"],
            )
        )
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")), lambda a: a["n"])

    # words are hashed once and windows are made of neighbours: a slice would copy the whole array each time
    windows = base.let(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.transform(F.sequence(F.lit(0), F.size(hs) - WINDOW), lambda i: F.xxhash64(*[F.get(hs, i + k) for k in range(WINDOW)])))
    found = base.let(
        windows,
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(base.let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)),
    )
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(found).cast("long")


def rule_counts(docs: DataFrame, keys: bool = False) -> DataFrame:
    """Counts and rule outcomes of every document; a null text has no words and one empty line.

    With keys, a hash of (doc_id, text, source) comes along as `key`.
    """
    text = F.col("__text")
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(base.WORD))
    df = docs.select("doc_id", F.col("source").alias("host"), base.text_of().alias("__text"), *([row_key().alias("key")] if keys else []))
    own = ["doc_id", "host", *(["key"] if keys else [])]
    df = df.select(
        *own,
        base.words_of(text).alias("__words"),
        with_word.alias("__lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("__upper"),
    )
    df = df.select(
        *own,
        F.size("__words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("__n_lines"),
        "__upper",
    )
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    strict = (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * n) | (100 * F.col("__upper") > MAX_UPPER_PERCENT * F.col("word_chars"))
    advisory = (F.col("word_chars") < MIN_WORD_CHARS * n) | (F.col("word_chars") > MAX_WORD_CHARS * n) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("__n_lines"))
    return df.select(*own, *COUNTS, failed.alias("base_failed"), strict.alias("strict_failed"), advisory.alias("advisory_failed"))


def host_verdicts(counts: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """host, n, failures, rate (posterior mean under the prior fitted to all hosts), suspect.

    With n_h documents and k_h failures on host h, m = sum k / sum n and v the variance of k_h/n_h
    weighted by n_h: what v exceeds sampling noise by is the prior's variance, which fixes its size.
    """
    any_failed = F.col("base_failed") | F.col("strict_failed") | F.col("advisory_failed")
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), F.sum(any_failed.cast("long")).alias("failures"))
    r, n = F.col("failures") / F.col("n"), F.col("n")
    moments = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("k"), F.sum(n * r * r).alias("rr"), F.count("*").alias("h"))
    m = F.col("k") / F.col("n")
    between = F.greatest(F.col("rr") / F.col("n") - m * m - F.col("h") * m * (1 - m) / F.col("n"), F.lit(1e-6))
    size = F.least(F.greatest(m * (1 - m) / between - 1, F.lit(1.0)), F.lit(1e6))
    prior = moments.select(F.struct(m.alias("mean"), size.alias("size"))).scalar()
    rate = (F.col("failures") + prior["mean"] * prior["size"]) / (F.col("n") + prior["size"])
    return hosts.select("host", "n", "failures", rate.alias("rate")).withColumn("suspect", F.col("rate") >= suspect_rate)


def judged(counts: DataFrame, suspect_rate: float) -> DataFrame:
    hosts = host_verdicts(counts, suspect_rate).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "suspect")
    joined = counts.join(hosts, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    kept = ~F.col("base_failed") & ~F.col("strict_failed") & ~(F.col("suspect") & F.col("advisory_failed"))
    return joined.withColumn("kept", F.coalesce(kept, F.lit(True)))


def row_key() -> Column:
    """128 bits for a row, as equal keys decide what goes."""
    return F.struct(F.xxhash64("doc_id", base.text_of(), "source").alias("a"), F.xxhash64(F.lit(1), "doc_id", base.text_of(), "source").alias("b"))


def good_documents(docs: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns. The keys of the others are broadcast if they are few enough.

    Nulls and repeated rows are judged as in quality_rules, each row for itself; an empty table stays empty.
    """
    counts = base.keep(rule_counts(docs, keys=True), "rule_counts")
    rejected = base.keep(judged(counts, suspect_rate).where("not kept").select(F.col("key").alias("__key")).distinct(), "rejected")
    few = rejected.count() <= base.BROADCAST_KEYS
    return docs.withColumn("__key", row_key()).join(F.broadcast(rejected) if few else rejected, "__key", "left_anti").drop("__key")


def quality_rules(docs: DataFrame, suspect_rate: float = SUSPECT_RATE) -> DataFrame:
    """One row per document: counts, base_failed, host_rate and kept.

    Nulls: a null text fails base (no words); a null source is a host of its own; a null doc_id is
    carried along. Repeated rows are counted and returned each. An empty table gives no rows. Other
    columns of docs are ignored. The join back is by host; where a host holds much of the table,
    the hosts' table is small and Spark broadcasts it below its own threshold, and beyond that its
    skew join splits the host.
    """
    return judged(base.keep(rule_counts(docs), "rule_counts"), suspect_rate)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(base.documents(spark, sf_dir)).select("doc_id", *COUNTS, "base_failed", "kept")


#: The moments are in the same order as above; the rates only meet a threshold, so rounding in sums does not show.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 4) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j)::BIGINT AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM rep) GROUP BY rid),
c AS (SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS up, len(ls) AS nl
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        100 * n_symbols > 10 * n_words OR 100 * up > 50 * word_chars AS strict_failed,
        word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_dup_lines > 30 * nl AS advisory_failed FROM c),
h AS (SELECT source, count(*) AS n, sum((base_failed OR strict_failed OR advisory_failed)::BIGINT)::DOUBLE AS k FROM f GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mean, sum(n) AS n, count(*) AS h, sum(n * (k / n) * (k / n)) / sum(n) AS rr FROM h),
p AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(rr - mean * mean - h * mean * (1 - mean) / n, 1e-6::DOUBLE) - 1, 1), 1e6::DOUBLE) AS size FROM m),
v AS (SELECT source, (k + mean * size) / (n + size) >= 0.5 AS suspect FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT strict_failed AND NOT (suspect AND advisory_failed) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
