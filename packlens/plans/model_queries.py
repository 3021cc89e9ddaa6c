"""Queries of garbled training lines, pruning, the choice of votes, and reports as rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import garble
from packlens.operators import classify, quality, reporting
from packlens.plans.label_queries import BIAS, GRAMS, MODEL
from packlens.sources import adapters as A
from packlens.sources.adapters import over

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- garbled copies


def _edit(n: int) -> str:
    """One edit of table e{n - 1} as table e{n}."""
    keys, values = ", ".join(f"'{k}'" for k in garble.CONFUSED), ", ".join(f"'{v}'" for v in garble.CONFUSED.values())
    u = lambda i: f"(('0x' || substr(h, {6 * i + 1}, 6))::BIGINT / 16777216.0::DOUBLE)"
    return f"""h{n} AS (SELECT *, md5('{garble.SEED}:' || id || ':' || copy || ':{n}') AS h FROM e{n - 1}),
 u{n} AS (SELECT *, {u(0)} AS u0, floor({u(1)} * length(t))::INTEGER + 1 AS p, {u(2)} AS u2, {u(3)} AS u3, {u(4)} AS u4 FROM h{n}),
 c{n} AS (SELECT *, substr(t, 1, p - 1) AS b, substr(t, p, 1) AS c, substr(t, p + 1) AS a, substr(t, p, 2) AS two, substr(t, p + 2) AS r, strpos(t, ' ') AS sp FROM u{n}),
 l{n} AS (SELECT *, CASE WHEN length(two) = 2 THEN ([{values}])[list_position([{keys}], two)] END AS one, coalesce(([{values}])[list_position([{keys}], c)], ([{values}])[list_position([{keys}], lower(c))]) AS lk FROM c{n}),
 e{n} AS (SELECT id, copy, n, CASE WHEN {n} > n OR t = '' OR copy = 0 THEN t
  WHEN u0 < 0.55::DOUBLE THEN CASE WHEN one IS NOT NULL AND u2 < 0.5::DOUBLE THEN b || one || r WHEN lk IS NOT NULL AND u3 < 0.8::DOUBLE THEN b || lk || a WHEN regexp_matches(c, '^\\p{{L}}$') THEN b || substr('abcdefghijklmnopqrstuvwxyz', floor(u4 * 26)::INTEGER + 1, 1) || a ELSE t END
  WHEN u0 < 0.70::DOUBLE THEN b || a WHEN u0 < 0.80::DOUBLE THEN CASE WHEN sp > 0 THEN substr(t, 1, sp - 1) || substr(t, sp + 1) ELSE b || a END
  WHEN u0 < 0.90::DOUBLE THEN b || CASE WHEN regexp_matches(c, '^\\p{{Ll}}$') THEN upper(c) ELSE lower(c) END || a
  ELSE b || substr('{garble.PUT_IN}', floor(u2 * 10)::INTEGER + 1, 1) || c || a END AS t FROM l{n})"""


@query(over("line", "").rstrip() + f""", e0 AS (SELECT scan_id::VARCHAR || '-' || line_no::VARCHAR AS id, copy, text AS t, greatest(1, least(4, floor(length(text)::DOUBLE / 12 * 1.2::DOUBLE)::INTEGER + 1)) AS n FROM line, range(16) x(copy)),
 {', '.join(_edit(n) for n in (1, 2, 3, 4))} SELECT id, copy::INTEGER AS copy, t AS text FROM e4""")
def garbled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fifteen garbled copies of every label line, beside the line."""
    lines = A.label_lines(spark, d).select(F.concat_ws("-", F.col("scan_id").cast("string"), F.col("line_no").cast("string")).alias("id"), "text")
    return garble.copies(lines).select("id", "copy", "text")


# --- pruning

_model = ", ".join(f"('{g}', {i}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for g, i, a, b, c in MODEL)
STEPS = (3.0, 2.1, 1.2, 0.3, 0.0)
GOLD = "CASE WHEN line_no = 3 THEN 'mrp' WHEN line_no = 1 THEN 'net_qty' WHEN line_no = 5 THEN 'batch' END"


@query(
    over("line", "").rstrip()
    + f""", {GRAMS}, m(gram, idf, w0, w1, w2) AS (VALUES {_model}), v AS (SELECT scan_id, line_no, c.n * idf AS v, w0, w1, w2 FROM c JOIN m USING (gram)),
 k(t) AS (VALUES {', '.join(f'({t}::DOUBLE)' for t in STEPS)}),
 s AS (SELECT scan_id, line_no, t, sqrt(sum(v * v)) AS norm, sum(CASE WHEN abs(w0) >= t THEN v * w0 ELSE 0 END) AS s0, sum(CASE WHEN abs(w1) >= t THEN v * w1 ELSE 0 END) AS s1, sum(CASE WHEN abs(w2) >= t THEN v * w2 ELSE 0 END) AS s2 FROM v, k GROUP BY ALL),
 z AS (SELECT l.scan_id, l.line_no, k.t, {GOLD.replace('line_no', 'l.line_no')} AS gold, 0.1::DOUBLE + coalesce(s0 / norm, 0) AS z0, coalesce(s1 / norm, 0) AS z1, coalesce(s2 / norm, 0) - 0.1::DOUBLE AS z2 FROM line l, k LEFT JOIN s ON l.scan_id = s.scan_id AND l.line_no = s.line_no AND k.t = s.t)
 SELECT CASE WHEN scan_id % 2 = 0 THEN 'even' ELSE 'odd' END AS "set", t AS threshold, count(*) AS n, round(avg(CASE WHEN CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'mrp' WHEN z1 >= z2 THEN 'net_qty' ELSE 'batch' END = gold THEN 1 ELSE 0 END), 9) AS accuracy FROM z WHERE gold IS NOT NULL GROUP BY ALL"""
)
def pruning_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy on two sets of label lines as a model's weights go, all thresholds in one pass."""
    idf = spark.createDataFrame([(g, i) for g, i, *_ in MODEL], "gram string, idf double")
    weights = spark.createDataFrame([(k, row[0], row[2 + k]) for row in MODEL for k in range(3)], "class_no int, gram string, weight double")
    bias = spark.createDataFrame(BIAS, "class_no int, class string, bias double")
    no = F.col("line_no")
    lines = A.label_lines(spark, d).select((F.col("scan_id") * 100 + no).alias("id"), F.when(F.col("scan_id") % 2 == 0, "even").otherwise("odd").alias("set"), "text", F.when(no == 3, "mrp").when(no == 1, "net_qty").when(no == 5, "batch").alias("gold"))
    return classify.ladder(lines.where("gold is not null"), idf, weights, bias, STEPS).withColumn("accuracy", F.round("accuracy", 9))


# --- votes

VOTES = """SELECT scan_id, photo, line_no, CASE WHEN scan_id % 3 <> 0 THEN 'transformer' WHEN scan_id % 2 = 0 THEN 'keywords' END AS engine FROM line"""


@query(over("line", f"SELECT *, CASE engine WHEN 'transformer' THEN 'mrp' WHEN 'keywords' THEN 'batch' ELSE 'other' END AS vote_class, CASE engine WHEN 'transformer' THEN 0.9::DOUBLE WHEN 'keywords' THEN 0.6::DOUBLE ELSE 0 END AS vote_prob FROM ({VOTES})"))
def chosen_votes(spark: SparkSession, d: str) -> DataFrame:
    """The first model's votes lack a line of every third scan; the second's, which has no vote for odd scans, stand in where they fit."""
    keys = ["scan_id", "photo", "line_no"]
    lines = A.label_lines(spark, d).select(*keys)
    first = lines.where("scan_id % 3 <> 0 or line_no <> 4").withColumns({"vote_class": F.lit("mrp"), "vote_prob": F.lit(0.9)})
    second = lines.where("scan_id % 2 = 0").withColumns({"vote_class": F.lit("batch"), "vote_prob": F.lit(0.6)})
    return quality.chosen_votes(lines, [("transformer", first), ("keywords", second)], keys, fall_back=True)


@query(over("line", """SELECT scan_id, CASE WHEN e IS NULL THEN 'Smart assist unavailable on this device — fell back to regex-only.' ELSE 'Smart-assist (keyword model) votes fused with regex validators.' END AS note
 FROM (SELECT scan_id, CASE WHEN scan_id % 3 <> 0 THEN 'keywords' END AS e FROM line GROUP BY scan_id)"""))
def mode_notes(spark: SparkSession, d: str) -> DataFrame:
    """What is said of each scan's mode where the better model isn't ready and the other doesn't fit every scan."""
    keys = ["scan_id", "photo", "line_no"]
    lines = A.label_lines(spark, d).select(*keys)
    votes = lines.where("scan_id % 3 <> 0 or line_no <> 4").withColumns({"vote_class": F.lit("mrp"), "vote_prob": F.lit(0.9)})
    chosen = quality.chosen_votes(lines, [("transformer", None), ("keywords", votes)], keys)
    return chosen.groupBy("scan_id").agg(F.max("engine").alias("engine")).select("scan_id", quality.mode_note("assisted", F.col("engine")).alias("note"))


# --- reports

_declared = ", ".join(f"'{label}: ' || coalesce(max(value) FILTER (WHERE field = '{field}'), '—')" for label, field in reporting.DECLARED)


@query(
    over("scan obs rr", "").rstrip()
    + f""", o AS (SELECT scan_id, field, max(value) AS value FROM obs WHERE status = 'found' GROUP BY ALL),
 v AS (SELECT scan_id, [{_declared}] AS declared FROM o GROUP BY scan_id),
 r AS (SELECT scan_id, list(struct_pack(code := code, clause := 'clause ' || code, t := upper(status) || ' — rule ' || rule_seq::VARCHAR || CASE WHEN severity = 'error' THEN ' [' || left(repeat(code || ' ', 20), 140) || ']' ELSE '' END || CASE WHEN status = 'fail' THEN ' (photo ' || (rule_seq % 3 + 1)::VARCHAR || ')' ELSE '' END) ORDER BY rule_seq, code, status, severity = 'error', rule_seq) AS rs FROM rr GROUP BY scan_id),
 x AS (SELECT s.*, declared, coalesce(rs, []) AS rs FROM scan s LEFT JOIN v ON s.id = v.scan_id LEFT JOIN r ON s.id = r.scan_id),
 l AS (SELECT id, list_concat(list_transform(['{reporting.HEADER[0]}', '{reporting.HEADER[1]}', 'Product: ' || product_name || '   |   Category: ' || category, 'Officer: —   |   Date: ' || strftime(created_at, '%Y-%m-%d'), 'Scan ID: ' || id::VARCHAR || '   |   Photos: ' || photo_count::VARCHAR], lambda t: {{'section': 'header', 'code': NULL, 'clause': NULL, 'text': t, 'colour': NULL}}),
  [{{'section': 'verdict', 'code': NULL, 'clause': NULL, 'text': CASE verdict WHEN 'compliant' THEN 'COMPLIANT' WHEN 'nonCompliant' THEN 'NON-COMPLIANT' ELSE 'NEEDS REVIEW' END || '  •  Score ' || score::VARCHAR || '/100', 'colour': CASE verdict WHEN 'compliant' THEN '#1B5E20' WHEN 'nonCompliant' THEN '#C1272D' ELSE '#B7791F' END}},
   {{'section': 'verdict', 'code': NULL, 'clause': NULL, 'text': '{reporting.SEMANTICS.replace("'", "''")}', 'colour': NULL}}],
  list_transform(list_concat(['Declared values (as extracted on device)'], coalesce(declared, [{', '.join(f"'{label}: —'" for label, _ in reporting.DECLARED)}])), lambda t: {{'section': 'declared', 'code': NULL, 'clause': NULL, 'text': t, 'colour': NULL}}),
  [{{'section': 'findings', 'code': NULL, 'clause': NULL, 'text': 'Rule findings', 'colour': NULL}}, {{'section': 'findings', 'code': 'Code', 'clause': 'Clause', 'text': 'Status / evidence', 'colour': NULL}}],
  list_transform(rs, lambda r: {{'section': 'findings', 'code': r.code, 'clause': r.clause, 'text': r.t, 'colour': NULL}}),
  list_transform(list_concat(['Photo evidence (reference URLs)'], CASE WHEN id % 3 = 0 THEN ['No photo URLs stored.'] ELSE ['Photo 1: /p/' || id::VARCHAR || '.jpg'] END), lambda t: {{'section': 'photos', 'code': NULL, 'clause': NULL, 'text': t, 'colour': NULL}}),
  list_transform(['{reporting.SIGNATURE}', 'Generated by the compliance server • reportJson checkedAt: — • meanConfidence: ' || regexp_replace(mean_confidence::VARCHAR, '\\.0$', '')], lambda t: {{'section': 'signature', 'code': NULL, 'clause': NULL, 'text': t, 'colour': NULL}})) AS ls FROM x)
 SELECT id AS scan_id, (i - 1)::INTEGER AS row_no, ls[i].section AS section, ls[i].code AS code, ls[i].clause AS clause, ls[i].text AS text, ls[i].colour AS colour FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM l)"""
)
def scan_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every scan's report, row by row."""
    k = F.col("id")
    scans = A.scans(spark, d).withColumn("image_urls", F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("/p/"), k.cast("string"), F.lit(".jpg")))))
    best = A.observations(spark, d).where("status = 'found'").groupBy("scan_id", "field").agg(F.max("value").alias("value"))
    r = A.rule_results(spark, d)
    evidence = F.when(F.col("severity") == "error", F.expr("repeat(code || ' ', 20)"))
    results = r.select("scan_id", "rule_seq", "code", F.concat(F.lit("clause "), F.col("code")).alias("clause"), "status", F.concat(F.lit("rule "), F.col("rule_seq").cast("string")).alias("message"), evidence.alias("evidence"), F.when(F.col("status") == "fail", F.col("rule_seq") % 3).alias("photo_index"))
    return reporting.report_rows(scans, best, results)
