"""Secret scans through a trigram index (operator 2), in DataFrame functions only.

Each rule's regex is turned, from its parse tree, into a Boolean query of trigrams that every match must
contain. The trigrams of all queries are indexed: postings (trigram, document), range-partitioned by
both, of lower-cased texts. Intersecting postings leaves the candidates of each rule, which alone are
verified with its regex. Rules without a mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Shortest accepted match, or content of `group`; shorter matches are dropped after matching.
    least: int = 0
    group: int = 0


#: The first three are the base kinds. Java, RE2 and Python read these regexes alike.
ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "(password|passwd|secret|token|api_?key)")
RULES = [
    Rule("assign", ASSIGN + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._%+-]{1,64}:[A-Za-z0-9._%+!$*-]{3,64}@"),
]
BASE_KINDS = 3
#: Matches whose positions are summed at once, and candidates (a key and numbers of rules) that are sent to all executors at most.
CHUNK, BROADCAST_CANDIDATES = 256, 1 << 19
#: A run of exact strings is cut when it stands for more strings than this.
MOST_STRINGS = 64


# --- Boolean trigram queries. A query is a list of clauses that must all hold; a clause is a list of
# alternatives; an alternative is a set of trigrams that must all occur.


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    return _query(sre.parse(regex))


def _exact(op, arg) -> set[str] | None:
    """The lower-cased strings that a node stands for, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        found: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL":
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] - x[0] < 8:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _exact_run(arg[3])
    if name == "BRANCH":
        parts = [_exact_run(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
        inner = _exact_run(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] == arg[1] and arg[0] <= 8:
        return _exact_run(list(arg[2]) * arg[0])
    return None


def _exact_run(nodes) -> set[str] | None:
    strings = {""}
    for op, arg in nodes:
        one = _exact(op, arg)
        if one is None or len(strings) * len(one) > MOST_STRINGS:
            return None
        strings = {a + b for a in strings for b in one}
    return strings


def _query(nodes) -> list[list[frozenset[str]]]:
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def flush() -> None:
        if min(map(len, run)) >= 3:
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))

    for op, arg in nodes:
        one = _exact(op, arg)
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        flush()
        run = one if one is not None else {""}
        name = str(op)
        if one is None and name == "SUBPATTERN":
            clauses += _query(arg[3])
        elif one is None and name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            clauses += _query(arg[2])
        elif one is None and name == "BRANCH":
            parts = [_query(x) for x in arg[1]]
            if all(parts):  # one clause of each branch is enough
                clauses.append(sorted({s for p in parts for s in p[0]}, key=sorted))
    flush()
    return clauses


# --- the index


def keyed(docs: DataFrame) -> DataFrame:
    text = base.text_of()
    return docs.select("doc_id", base.row_key(text).alias("rid"), text.alias("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, rid) of these trigrams, clustered by both, so that one with very many documents is spread."""
    low = docs.select("rid", base.ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    # written before it is ranged, so that sampling for the ranges doesn't read all texts again
    rows = base.keep(low.select("rid", F.explode(found).alias("trigram")), "trigrams")
    return base.keep(rows.repartitionByRange("trigram", "rid").sortWithinPartitions("trigram", "rid"), "postings")


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rid, rules): for each document the numbers of the indexed rules whose trigram query it satisfies."""
    spark = docs.sparkSession
    queries = {r: q for r, q in ((r, trigram_query(x.regex)) for r, x in enumerate(rules)) if q}
    wanted = [(t, r, c, a, len(s)) for r, q in queries.items() for c, alts in enumerate(q) for a, s in enumerate(alts) for t in sorted(s)]
    index = postings(docs, sorted({x[0] for x in wanted}))
    query = spark.createDataFrame(wanted, "trigram string, rule int, clause int, alternative int, size int")
    clauses = spark.createDataFrame([(r, len(q)) for r, q in queries.items()], "rule int, clauses int")
    # both are as large as the rules, whatever the documents
    hits = index.join(F.broadcast(query), "trigram").groupBy("rid", "rule", "clause", "alternative", "size").agg(F.count_distinct("trigram").alias("n")).where("n = size")
    held = hits.groupBy("rid", "rule").agg(F.count_distinct("clause").alias("held")).join(F.broadcast(clauses), "rule").where("held = clauses")
    return held.groupBy("rid").agg(F.collect_set("rule").alias("rules"))


# --- verification


def rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Sorted structs (start, rank, end, kind) of a rule's matches in code points, end exclusive.

    What lies between the matches and the matches alternate, so that running lengths are positions. They
    are summed over chunks first and then within each, because a fold copies its list for every match.
    """
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    between = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    lengths = F.arrays_zip(between.alias("gap"), F.transform(whole, lambda x: F.length(x)).alias("n"), F.transform(judged, lambda x: F.length(x)).alias("judged"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    size = lambda x: x["gap"] + F.coalesce(x["n"], F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["judged"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def placed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + size(x)))
        firsts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        return base.let(firsts, lambda f: F.flatten(F.transform(chunks, lambda c, i: F.aggregate(c, F.struct(F.get(f, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))

    chunks = base.let(lengths, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, CHUNK)))
    return F.when(text.rlike(rule.regex), base.let(chunks, placed)).otherwise(none)


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, text and spans (start, rank, end, kind), sorted by start and rule, for every row of docs.

    A null text is empty and has no spans. Null ids and repeated rows are rows like others. An empty
    table gives no rows; other columns are ignored. Spans of different rules may overlap. Long texts are
    scanned whole; time is in proportion to matches.
    """
    rules = RULES if rules is None else rules
    docs = keyed(docs)
    indexed = [bool(trigram_query(x.regex)) for x in rules]
    found = candidates(docs, rules) if any(indexed) else docs.sparkSession.createDataFrame([], "rid long, rules array<int>")
    found = base.keep(found, "candidates")
    # beyond what can be broadcast, all texts are shuffled once to meet their candidates
    df = docs.join(F.broadcast(found) if found.count() <= BROADCAST_CANDIDATES else found, "rid", "left")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = [F.when(F.array_contains("rules", i), rule_spans(F.col("text"), i, x)).otherwise(none) if indexed[i] else rule_spans(F.col("text"), i, x) for i, x in enumerate(rules)]
    return df.select("doc_id", "text", F.sort_array(F.concat(*parts)).alias("spans"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = secret_spans(base.documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long")
    base_spans = F.filter("spans", lambda x: x["rank"] < BASE_KINDS)
    return df.select("doc_id", *[count(k).alias(f"n_{RULES[k].kind}") for k in range(BASE_KINDS)], F.sha2(written(base_spans), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _sql() -> str:
    """Every regex over every text, without the index."""
    quoted = lambda s: s.replace("'", "''")
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS rank, '{x.kind}' AS kind, regexp_extract_all(t, '{quoted(x.regex)}', 0) AS m, regexp_extract_all(t, '{quoted(x.regex)}', {x.group}) AS g, "
        f"string_split_regex(t, '{quoted(x.regex)}') AS p, {x.least} AS least FROM d WHERE regexp_matches(t, '{quoted(x.regex)}')"
        for i, x in enumerate(RULES)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
a AS ({parts}),
u AS (SELECT rid, rank, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g) AS g, unnest(list_slice(p, 1, len(m))) AS p FROM a),
s AS (SELECT rid, rank, kind, length(g) >= least AS ok, sum(length(p) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) - length(m) AS start, length(m) AS n FROM u),
k AS (SELECT rid, rank, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS w FROM s WHERE ok)
SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  sha256(coalesce(string_agg(w, ',' ORDER BY start, rank) FILTER (WHERE rank < 3), '')) AS base_sha256, coalesce(string_agg(w, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN k ON d.rid = k.rid GROUP BY d.rid, doc_id
"""


OP2_SQL = _sql()
