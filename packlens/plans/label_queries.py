"""Queries of text cleaning, layout, extraction, classification and second reading, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import labels as L
from packlens.functions import text as T
from packlens.operators import classify, cleantext, extract, layout, merge, quality, reread, rules
from packlens.sources import adapters as A
from packlens.sources import scratch
from packlens.sources.adapters import over
from packlens.streaming import outbox as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the common core

BLEND = "floor(({s}) * (0.55::DOUBLE + 0.45::DOUBLE * least(greatest({c}, 0.0::DOUBLE), 1.0::DOUBLE)) * 100 + 0.5::DOUBLE) / 100"
STATUS = "CASE WHEN confidence >= 0.70::DOUBLE THEN 'found' WHEN confidence >= 0.45::DOUBLE THEN 'unverified' ELSE 'notFound' END AS status"
AFTER = "(CASE WHEN instr(lower(text), lower({0})) > 0 THEN substr(text, instr(lower(text), lower({0})) + length({0})) ELSE '' END)"
LAST_WORD = AFTER.format("string_split(label, ' ')[-1]")


def blend(s: str, c: str = "ocr") -> str:
    return BLEND.format(s=s, c=c)


def hit_sql(field: str) -> str:
    found = ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN {{'s': {s}::DOUBLE, 'o': {-i}, 'l': regexp_extract(text, '{p}', 0, 'i')}} END" for i, (p, s) in enumerate(L.LABELS[field]))
    return f"SELECT * EXCLUDE (h), h.s AS strength, h.l AS label, line_no AS hit_seq FROM (SELECT *, list_max(list_filter([{found}], lambda x: x IS NOT NULL)) AS h FROM line) WHERE h IS NOT NULL"


def attempt_sql(hits: str = "hit") -> str:
    full = AFTER.format("label")
    return f"""SELECT scan_id, photo, hit_seq, strength, label, text AS label_text, -1 AS attempt_seq, 1.0::DOUBLE AS prox, 'same_line_right' AS relationship, CASE WHEN trim({full}) <> '' THEN {full} ELSE {LAST_WORD} END AS attempt, conf AS ocr FROM {hits}
 UNION ALL SELECT h.scan_id, h.photo, hit_seq, strength, label, h.text, l.line_no, CASE WHEN abs(l.cy - h.cy) < 0.03::DOUBLE THEN 0.95::DOUBLE ELSE 0.75::DOUBLE END, CASE WHEN abs(l.cy - h.cy) < 0.03::DOUBLE THEN 'same_row' ELSE 'nearby' END, l.text, l.conf
 FROM {hits} h JOIN line l ON h.scan_id = l.scan_id AND h.photo = l.photo WHERE h.line_no <> l.line_no AND abs(l.cy - h.cy) < 0.07::DOUBLE AND trim(l.text) <> ''"""


def best_sql(candidates: str, order: str = "hit_seq, attempt_seq") -> str:
    return f"SELECT *, {STATUS} FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, photo ORDER BY confidence DESC, {order}) AS rn FROM ({candidates})) WHERE rn = 1"


def or_label(best: str, columns: str, nulls: str) -> str:
    return f"""SELECT scan_id, photo, status, {columns}, confidence, label, relationship FROM best UNION ALL
 SELECT scan_id, photo, 'unverified', {nulls}, 0.5::DOUBLE, label, 'label_only' FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, photo ORDER BY line_no) AS rn FROM hit) h WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.scan_id = h.scan_id AND b.photo = h.photo)"""


def shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("scan_id", "photo", "status", *columns, "confidence", "label", "relationship")


# --- extraction

WRAP = r"^\s*(weight|wt\.?|qty\.?|quantity|contents?)\b"
_units = ", ".join(f"'{k}': '{v}'" for k, v in merge.UNITS.items())
NET = f"""hit AS ({hit_sql("netQty")}), nx AS (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM line WINDOW w AS (PARTITION BY scan_id, photo, block_no ORDER BY line_no)),
 more AS (SELECT * EXCLUDE (before, after), 0.9::DOUBLE AS strength, 'NET ' || trim(text) AS label, line_no + 100000 AS hit_seq FROM nx WHERE regexp_matches(before, '^\\s*net\\s*$', 'i') AND regexp_matches(text, '{WRAP}', 'i')
  UNION ALL SELECT * EXCLUDE (before, after), 0.85::DOUBLE, 'NET', line_no + 100000 FROM nx WHERE regexp_matches(text, '^\\s*net\\s*$', 'i') AND NOT coalesce(regexp_matches(after, '{WRAP}', 'i'), false)),
 allhit AS (SELECT * FROM hit UNION ALL BY NAME SELECT * FROM more), att AS ({attempt_sql("allhit")}),
 q AS (SELECT *, try_cast(replace(regexp_extract(attempt, '{L.QUANTITY}', 1, 'i'), ',', '.') AS DOUBLE) AS number, MAP {{{_units}}}[lower(regexp_extract(attempt, '{L.QUANTITY}', 2, 'i'))] AS unit
  FROM att WHERE trim(attempt) <> '' AND NOT regexp_matches(attempt, '{L.SERVING}', 'i'))
 SELECT scan_id, photo, status, number, unit, confidence, label, relationship FROM ({best_sql(f"SELECT *, {blend('strength * prox')} AS confidence FROM q WHERE unit IS NOT NULL AND number > 0 AND number < 1e6")})"""


@query(over("line", "").rstrip() + ", " + NET)
def extract_net_qty(spark: SparkSession, d: str) -> DataFrame:
    return shown(extract.net_quantity(A.label_lines(spark, d)), "number", "unit")


def price_part(i: int) -> str:
    return f"regexp_extract(scrubbed, '{L.PRICE}', {i}, 'i')"


MRP = f"""hit AS ({hit_sql("mrp")}), att AS ({attempt_sql()}), s AS (SELECT *, regexp_replace(attempt, '{L.PER_UNIT}', ' ', 'g') AS scrubbed FROM att),
 p AS (SELECT *, {price_part(1)} AS cur, replace({price_part(2)}, ',', '') AS whole, {price_part(3)} AS part FROM s),
 n AS (SELECT *, try_cast(CASE WHEN part <> '' THEN whole || '.' || part ELSE whole END AS DOUBLE) AS number,
  CASE WHEN cur <> '' THEN 0.95::DOUBLE WHEN part <> '' OR regexp_matches(label_text, '{L.CURRENCY}', 'i') THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS pattern FROM p WHERE whole <> ''),
 best AS ({best_sql(f"SELECT *, {blend('strength * (pattern * prox)')} AS confidence FROM n WHERE NOT regexp_matches(whole, '^[0-9]{{8,}}$') AND number > 0 AND number <= 1e6")})
 {or_label("best", "number", "NULL")}"""


@query(over("line", "").rstrip() + ", " + MRP)
def extract_mrp(spark: SparkSession, d: str) -> DataFrame:
    return shown(extract.price(A.label_lines(spark, d)), "number")


_stop = ", ".join(f"'{w}'" for w in L.BATCH_STOP)
BATCH = f"""hit AS ({hit_sql("batch")}), att AS ({attempt_sql()}), w AS (SELECT *, regexp_extract_all(attempt, '{L.BATCH}', 1, 'i') AS vs FROM att),
 v AS (SELECT * EXCLUDE (vs), unnest(range(len(vs))) AS match_no, unnest(vs) AS value FROM w), g AS (SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) AS digits FROM v),
 best AS ({best_sql(f"SELECT *, {blend('strength * prox * CASE relationship WHEN ' + chr(39) + 'same_line_right' + chr(39) + ' THEN 1.0::DOUBLE ELSE 0.95::DOUBLE END')} AS confidence FROM g WHERE lower(regexp_replace(value, '[-/]', '', 'g')) NOT IN ({_stop}) AND digits > 0 AND (digits >= 2 OR length(value) >= 5) AND NOT contains(value, '/') AND NOT contains(value, '.') AND NOT regexp_matches(value, '^[0-9]{{8,}}$')", "hit_seq, attempt_seq, match_no")})
 {or_label("best", "value", "NULL")}"""


@query(over("line", "").rstrip() + ", " + BATCH)
def extract_batch(spark: SparkSession, d: str) -> DataFrame:
    return shown(extract.batch(A.label_lines(spark, d)), "value")


def date_sql(field: str) -> str:
    return f"""hit AS ({hit_sql(field)}), att AS ({attempt_sql()}),
 c AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(attempt, '\\(.*', '', 'g'), '[^0-9./\\-A-Za-z ]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM att),
 n AS (SELECT *, regexp_extract(clean, '{L.DATE_NUMBER}', 0) AS numeric, try_cast(regexp_extract(clean, '{L.DATE_NUMBER}', 3) AS INTEGER) AS y FROM c),
 m AS (SELECT *, CASE WHEN numeric <> '' THEN numeric ELSE regexp_extract(clean, '{L.DATE_WORD}', 0, 'i') END AS value, CASE WHEN y >= 100 THEN y WHEN y <= 49 THEN y + 2000 ELSE y + 1900 END AS yy FROM n),
 best AS ({best_sql(f"SELECT *, {blend('strength * prox')} AS confidence FROM m WHERE value <> '' AND (numeric = '' OR yy BETWEEN 1990 AND 2045)")})
 {or_label("best", "value", "NULL")}"""


@query(over("line", "").rstrip() + ", " + date_sql("mfg"))
def extract_mfg_date(spark: SparkSession, d: str) -> DataFrame:
    return shown(extract.date(A.label_lines(spark, d), "mfg"), "value")


@query(over("line", "").rstrip() + ", " + date_sql("exp"))
def extract_exp_date(spark: SparkSession, d: str) -> DataFrame:
    return shown(extract.date(A.label_lines(spark, d), "exp"), "value")


def any_label(field: str, text: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}', 'i')" for p, _ in L.LABELS[field]) + ")"


# grouped, not a window: DuckDB's string_agg over a window loses texts where the window doesn't fit its memory
BLOCK = "blk AS (SELECT * FROM line JOIN (SELECT scan_id, photo, block_no, string_agg(text, chr(10) ORDER BY line_no) AS block_text FROM line GROUP BY ALL) USING (scan_id, photo, block_no))"
PHONE = f"""{BLOCK}, c AS (SELECT *, {any_label("care", "block_text")} AS care, regexp_extract(text, '(^|[^0-9])({L.LANDLINE})([^0-9]|$)', 2) AS land, regexp_extract(text, '(^|[^0-9])({L.TOLL_FREE})([^0-9]|$)', 2) AS free,
  regexp_extract(text, '(^|[^0-9])({L.MOBILE})([^0-9]|$)', 2) AS mob FROM blk),
 k AS (SELECT scan_id, photo, line_no, 0 AS match_no, regexp_replace(regexp_replace(land, '\\s+', '', 'g'), '\\.+', '-', 'g') AS value, {blend("0.95::DOUBLE * CASE WHEN care THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END", "conf")} AS confidence FROM c WHERE land <> '' AND length(regexp_replace(text, '[^0-9]', '', 'g')) < 12
  UNION ALL SELECT scan_id, photo, line_no, 1, regexp_replace(regexp_replace(free, '\\s+', '', 'g'), '\\.+', '-', 'g'), {blend("0.95::DOUBLE * CASE WHEN care THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END", "conf")} FROM c WHERE free <> ''
  UNION ALL SELECT scan_id, photo, line_no, 2, mob, {blend("CASE WHEN care THEN 0.8::DOUBLE ELSE 0.55::DOUBLE END * CASE WHEN care THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END", "conf")} FROM c WHERE mob <> '' AND length(regexp_replace(text, '[^0-9]', '', 'g')) < 12)
 SELECT scan_id, photo, status, value, confidence FROM ({best_sql("SELECT * FROM k", "line_no, match_no")})"""


@query(over("line", "").rstrip() + ", " + PHONE)
def extract_phone(spark: SparkSession, d: str) -> DataFrame:
    return extract.phone(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", "confidence")


@query(over("line", "").rstrip() + f", {BLOCK}, c AS (SELECT *, regexp_extract(text, '{L.EMAIL}', 0) AS m, {any_label('care', 'block_text')} AS care FROM blk) SELECT scan_id, photo, status, value, confidence FROM ({best_sql('SELECT *, m AS value, ' + blend('CASE WHEN care THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END', 'conf') + " AS confidence FROM c WHERE m <> ''", 'line_no')})")
def extract_email(spark: SparkSession, d: str) -> DataFrame:
    return extract.email(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", "confidence")


@query(over("line", "").rstrip() + f", {BLOCK}, c AS (SELECT *, regexp_extract(text, '(^|[^0-9])([0-9]{{14}})([^0-9]|$)', 2) AS value FROM blk WHERE {any_label('fssai', 'block_text')}) SELECT scan_id, photo, status, value, confidence FROM ({best_sql('SELECT *, ' + blend('0.95::DOUBLE', 'conf') + " AS confidence FROM c WHERE value <> ''", 'line_no')})")
def extract_fssai(spark: SparkSession, d: str) -> DataFrame:
    return extract.fssai(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", "confidence")


ORIGIN = f"""hit AS ({hit_sql("origin")}), v AS (SELECT *, trim(string_split_regex(trim({AFTER.format("label")}), '[.,;]')[1]) AS raw FROM hit),
 f AS (SELECT *, array_to_string(list_transform(string_split(raw, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS value, {blend("strength", "conf")} AS confidence, row_number() OVER (PARTITION BY scan_id, photo ORDER BY line_no) AS rn FROM v WHERE length(raw) >= 3)
 SELECT scan_id, photo, {STATUS}, value, confidence FROM f WHERE rn = 1"""


@query(over("line", "").rstrip() + ", " + ORIGIN)
def extract_origin(spark: SparkSession, d: str) -> DataFrame:
    return extract.origin(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", "confidence")


@query(over("line", f"SELECT scan_id, photo, {STATUS}, value, confidence FROM (SELECT *, {blend('CASE WHEN top > 0.55::DOUBLE THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END', 'conf')} AS confidence, row_number() OVER (PARTITION BY scan_id, photo ORDER BY line_no) AS rn FROM (SELECT *, regexp_replace(text, '[^0-9]', '', 'g') AS value FROM line) WHERE length(value) >= 8 AND length(regexp_replace(text, '[0-9\\s]', '', 'g')) <= 2) WHERE rn = 1"))
def extract_barcode(spark: SparkSession, d: str) -> DataFrame:
    return extract.barcode(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", "confidence")


MAKER = f"""hit AS ({hit_sql("manufacturer")}), r AS (SELECT *, trim({AFTER.format("label")}) AS rest FROM hit),
 g AS (SELECT r.*, (SELECT list(trim(l.text) ORDER BY l.line_no) FROM line l WHERE l.scan_id = r.scan_id AND l.photo = r.photo AND l.block_no = r.block_no AND l.line_no > r.line_no) AS later FROM r),
 c AS (SELECT *, list_concat([rest], list_slice(coalesce(later, []), 1, 3)) AS got FROM g),
 v AS (SELECT *, trim(regexp_replace(got[1], '^[\\s:,-]+', '')) AS value, array_to_string(list_slice(got, 2, 5), ', ') AS address, {blend("strength * CASE WHEN regexp_matches(array_to_string(got, ' '), '\\b[1-9][0-9]{5}\\b') OR len(got) >= 3 THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END", "conf")} AS confidence FROM c)
 SELECT scan_id, photo, status, value, address, confidence, label FROM ({best_sql("SELECT * FROM v WHERE length(value) >= 3", "line_no")})"""


@query(over("line", "").rstrip() + ", " + MAKER)
def extract_manufacturer(spark: SparkSession, d: str) -> DataFrame:
    return extract.manufacturer(A.label_lines(spark, d)).select("scan_id", "photo", "status", "value", F.col("unit").alias("address"), "confidence", "label")


@query(over("line", f"SELECT scan_id, photo, {STATUS}, value, confidence FROM (SELECT scan_id, photo, {blend('0.9::DOUBLE', 'conf')} AS confidence, text || coalesce(' ' || (SELECT string_agg(trim(l.text), ' ' ORDER BY l.line_no) FROM line l WHERE l.scan_id = line.scan_id AND l.block_no = line.block_no AND l.line_no > line.line_no), '') AS value FROM line WHERE line_no = 9)"))
def extract_block_text(spark: SparkSession, d: str) -> DataFrame:
    return extract.block_field(A.label_lines(spark, d), "ingredients", r"^Plot(?![A-Za-z0-9_])").select("scan_id", "photo", "status", "value", "confidence")


FITS = f"length(trim(text)) BETWEEN 2 AND 60 AND top <= 0.42::DOUBLE AND NOT regexp_matches(trim(text), '{L.NOT_A_NAME}', 'i') AND right(trim(text), 1) <> '!' AND length(regexp_replace(text, '[^0-9]', '', 'g')) <= length(trim(text))::DOUBLE / 2 AND len(string_split_regex(trim(text), '\\s+')) <= 8"
IDENTITY = f"""c AS (SELECT *, row_number() OVER (PARTITION BY scan_id, photo ORDER BY line_no) AS rn, count(*) OVER (PARTITION BY scan_id, photo) AS n, len(string_split_regex(trim(text), '\\s+')) AS words FROM line WHERE {FITS}),
 f AS (SELECT scan_id, photo, 'brand' AS field, trim(text) AS value, least({blend("0.75::DOUBLE", "conf")}, 0.95::DOUBLE) AS confidence, false AS lone FROM c WHERE rn = 1 UNION ALL
  SELECT scan_id, photo, 'productName', trim(text), CASE WHEN n = 1 AND words < 2 THEN {blend("0.5::DOUBLE", "conf")} ELSE least({blend("0.8::DOUBLE", "conf")}, 0.95::DOUBLE) END, n = 1 AND words < 2 FROM c WHERE (n >= 2 AND rn = 2) OR n = 1),
 g AS (SELECT * EXCLUDE (lone), CASE WHEN lone THEN 'unverified' WHEN confidence >= 0.70::DOUBLE THEN 'found' WHEN confidence >= 0.45::DOUBLE THEN 'unverified' ELSE 'notFound' END AS status FROM f)
 SELECT scan_id, field, value, confidence, status FROM g UNION ALL SELECT scan_id, 'genericName', value, confidence, CASE WHEN status = 'found' AND confidence >= 0.6::DOUBLE THEN 'found' ELSE 'unverified' END FROM g WHERE field = 'productName'"""


@query(over("line", "").rstrip() + ", " + IDENTITY)
def extract_identity(spark: SparkSession, d: str) -> DataFrame:
    return extract.identity(A.label_lines(spark, d)).select("scan_id", "field", "value", "confidence", "status")


@query()
def extract_product(spark: SparkSession, d: str) -> DataFrame:
    return extract.product(A.label_lines(spark, d))


#: Each field's own SQL, for all fields at once; the label lines have no ingredients and no allergens.
PRODUCT = " UNION ALL ".join(
    [f"SELECT scan_id, photo, '{field}' AS field, status, confidence FROM ({ORACLE_SQL[name]})" for field, name in {"netQty": "extract_net_qty", "mrp": "extract_mrp", "batch": "extract_batch", "mfg": "extract_mfg_date", "exp": "extract_exp_date", "manufacturer": "extract_manufacturer", "carePhone": "extract_phone", "careEmail": "extract_email", "fssai": "extract_fssai", "origin": "extract_origin", "barcode": "extract_barcode"}.items()]
    + [f"SELECT scan_id, 0 AS photo, field, status, confidence FROM ({ORACLE_SQL['extract_identity']})"]
)


@query(PRODUCT)
def product_fields(spark: SparkSession, d: str) -> DataFrame:
    """All fields of every label in one plan, against a union of each field's SQL."""
    return extract.product(A.label_lines(spark, d)).select("scan_id", "photo", "field", "status", "confidence")


@query()
def label_reports(spark: SparkSession, d: str) -> DataFrame:
    """Lines to fields to rules to verdicts, end to end."""
    lines = A.label_lines(spark, d)
    observed = extract.product(lines).withColumn("photo_index", F.col("photo"))
    best = merge.merged(observed)
    data = F.create_map(F.lit("address"), F.when(F.col("field") == "manufacturer", F.col("unit")), F.lit("role"), extract.role(F.col("label")))
    text = lines.groupBy("scan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("ocr_text"), F.avg("conf").alias("mean_confidence"), F.count("*").alias("region_count"))
    scans = text.select(F.col("scan_id").alias("id"), F.lit("food").alias("category"), "ocr_text", "mean_confidence", "region_count", F.length("ocr_text").alias("total_chars"))
    df = rules.evaluated(scans, best.withColumn("data", data))
    return df.select("id", rules.score(F.col("results")).alias("score"), rules.verdict(F.col("results")).alias("verdict"), F.size("results").alias("n_rules"))


# --- text

NOISY = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '  Energy  537 kcd ' WHEN 1 THEN '(' || p_size::VARCHAR || 'g' WHEN 2 THEN p_size::VARCHAR || ' . 5 %' WHEN 3 THEN 'Lay' || chr(39) || 's ' || chr(34) || p_brand || chr(34) WHEN 4 THEN '80ml [x]]' ELSE p_name END AS t FROM part"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    t = F.when(k % 6 == 0, "  Energy  537 kcd ").when(k % 6 == 1, F.concat(F.lit("("), s, F.lit("g"))).when(k % 6 == 2, F.concat(s, F.lit(" . 5 %"))).when(k % 6 == 3, F.concat(F.lit("Lay's \""), F.col("p_brand"), F.lit('"'))).when(k % 6 == 4, "80ml [x]]").otherwise(F.col("p_name"))
    return A.table(spark, d, "part").select(k.alias("id"), t.alias("t"))


@query(f"SELECT id, CASE id % 6 WHEN 0 THEN 'Energy 537 kcal' WHEN 1 THEN substr(t, 2, length(t) - 2) || ' g' WHEN 2 THEN replace(replace(t, ' . ', '.'), ' %', '%') WHEN 3 THEN replace(t, chr(34), '') WHEN 4 THEN '80 ml [x]' ELSE t END AS clean FROM ({NOISY})")
def clean_token(spark: SparkSession, d: str) -> DataFrame:
    return noisy(spark, d).select("id", T.clean_token(F.col("t")).alias("clean"))


GLUED = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ALLERGENADVICE:ContainsSoy Mak' WHEN 1 THEN 'Oil(Palm),Sugar' WHEN 2 THEN 'PROTOIN 5g Sodum Enengy' ELSE 'Per  100 g serve   size' END AS t FROM part"


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN 'ALLERGEN ADVICE: Contains Soy Milk' WHEN 1 THEN 'Oil (Palm), Sugar' WHEN 2 THEN 'PROTEIN 5g Sodium Energy' ELSE 'Per 100 g serve size' END AS fixed FROM ({GLUED})")
def fix_line(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = F.when(k % 4 == 0, "ALLERGENADVICE:ContainsSoy Mak").when(k % 4 == 1, "Oil(Palm),Sugar").when(k % 4 == 2, "PROTOIN 5g Sodum Enengy").otherwise("Per  100 g serve   size")
    return A.spread(A.table(spark, d, "part"), "p_partkey").select(k.alias("id"), T.fixed_line(t).alias("fixed"))


_vocab = ", ".join(f"({i}, '{w.lower()}', '{w}')" for i, w in enumerate(T.VOCABULARY))


@query(
    f"""WITH v(i, low, word) AS (VALUES {_vocab}), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS w FROM conversations),
 p AS (SELECT w, i, low, word, levenshtein(low, w) AS dist FROM w JOIN v ON abs(length(low) - length(w)) <= 2), b AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY dist, i) AS rn FROM p)
 SELECT w AS word, word AS snapped FROM b WHERE rn = 1 AND dist <= CASE WHEN length(w) >= 9 THEN 2 ELSE 1 END AND (dist < 2 OR low[1] = w[1])"""
)
def snap_vocab(spark: SparkSession, d: str) -> DataFrame:
    words = A.table(spark, d, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("snapped", T.snapped(F.col("word"))).where("snapped is not null")


@query(
    """WITH l AS (SELECT doc_id AS scan_id, unnest(range(len(ws))) AS line_no, unnest(ws) AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
 h AS (SELECT scan_id, line_no, CASE WHEN line_no % 3 = 0 THEN w || '-' ELSE w END AS text FROM l),
 p AS (SELECT *, sum(CASE WHEN lag_text IS NOT NULL AND right(lag_text, 1) = '-' AND regexp_matches(text, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY scan_id ORDER BY line_no) AS part, right(text, 1) = '-' AND coalesce(regexp_matches(lead_text, '^[a-z]'), false) AS goes FROM (SELECT *, lag(text) OVER w AS lag_text, lead(text) OVER w AS lead_text FROM h WINDOW w AS (PARTITION BY scan_id ORDER BY line_no)))
 SELECT scan_id, min(line_no)::INTEGER AS line_no, string_agg(CASE WHEN goes THEN left(text, length(text) - 1) ELSE text END, '' ORDER BY line_no) AS text FROM p GROUP BY scan_id, part"""
)
def hyphen_wrap(spark: SparkSession, d: str) -> DataFrame:
    lines = A.table(spark, d, "documents").select(F.col("doc_id").alias("scan_id"), F.posexplode(F.split("text", " ")).alias("line_no", "w"))
    lines = lines.select("scan_id", "line_no", F.when(F.col("line_no") % 3 == 0, F.concat("w", F.lit("-"))).otherwise(F.col("w")).alias("text"))
    return T.unwrapped(lines, "scan_id")


# --- layout


def tokens(spark: SparkSession, d: str) -> DataFrame:
    words = A.label_lines(spark, d).select("scan_id", "photo", "line_no", "block_no", "conf", F.posexplode(F.split("text", " ")).alias("i", "text"))
    y = F.col("line_no") * 40.0 + F.col("block_no") * 25 + (F.col("scan_id") + F.col("i")) % 5
    return words.select("scan_id", "photo", (F.col("line_no") * 100 + F.col("i")).alias("token_id"), "text", "conf", (F.col("i") * 80.0).alias("x1"), y.alias("y1"), (F.col("i") * 80.0 + 70).alias("x2"), (y + 20).alias("y2"), F.lit(1000.0).alias("img_w"), F.lit(1000.0).alias("img_h"))


@query(over("line", "SELECT scan_id, photo, line_no, text FROM line"))
def line_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Words that were scattered over lines come together again as they were."""
    return layout.lines(tokens(spark, d)).select("scan_id", "photo", F.col("line_no").cast("int").alias("line_no"), "text")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of two lines a part: its name, each word found twice, and its price, a digit a region."""
    p = A.spread(A.table(spark, d, "part"), "p_partkey").select(F.col("p_partkey").alias("scan_id"), "p_name", F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long").cast("string").alias("digits"))
    item = lambda text, conf, x1, x2, y1: F.struct(text.alias("text"), F.lit(conf).alias("conf"), x1.alias("x1"), x2.alias("x2"), y1.alias("y1"))
    at = lambda i: i * 100.0
    shift = (F.col("scan_id") % 5).cast("double")
    words = F.transform(F.split("p_name", " "), lambda w, i: item(w, 0.9, at(i), at(i) + 80, shift))
    doubles = F.transform(F.split("p_name", " "), lambda w, i: item(F.upper(w), 0.6, at(i) + 4, at(i) + 84, shift + 1))
    specks = F.array(item(F.lit("'"), 0.9, F.lit(300.0), F.lit(310.0), F.lit(0.0)), item(F.lit("blur"), 0.4, F.lit(400.0), F.lit(480.0), F.lit(0.0)))
    price = F.transform(F.split("digits", ""), lambda c, i: item(c, 0.8, 200 + i * 13.0, 212 + i * 13.0, 60.0 + i % 2))
    rows = p.select("scan_id", F.lit(0).alias("photo"), F.posexplode(F.concat(price, specks, doubles, words, F.array(item(F.lit("kcal"), 0.9, F.lit(400.0), F.lit(470.0), F.lit(60.0))))).alias("token_id", "r"))
    return rows.select("scan_id", "photo", "token_id", "r.text", "r.conf", "r.x1", "r.y1", "r.x2", (F.col("r.y1") + 20).alias("y2"))


@query("SELECT p_partkey AS scan_id, 0 AS photo, p_name || chr(10) || floor(p_retailprice * 100 + 0.5::DOUBLE)::BIGINT || ' kcal' AS text FROM part")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Specks go, doubled detections count once, digits come together, lines are in reading order."""
    return cleantext.clean_text(regions(spark, d), lexicon=False)


@query("SELECT p_partkey AS scan_id, 0 AS photo, (2 * len(string_split(p_name, ' ')) * 7.5::DOUBLE + 8 * length((floor(p_retailprice * 100 + 0.5::DOUBLE)::BIGINT)::VARCHAR) + 9)  / 10 / (2 * len(string_split(p_name, ' ')) + length((floor(p_retailprice * 100 + 0.5::DOUBLE)::BIGINT)::VARCHAR) + 1) AS mean_confidence FROM part")
def kept_confidence(spark: SparkSession, d: str) -> DataFrame:
    r = regions(spark, d)
    return cleantext.mean_confidence(r, cleantext.reading_order(r))


@query(over("line", "SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE line_no % 3 = 1 AND trim(text) <> trim(upper(text))) AS n_changed FROM line GROUP BY scan_id"))
def line_edits(spark: SparkSession, d: str) -> DataFrame:
    lines = A.label_lines(spark, d)
    answers = lines.where("line_no % 3 = 1").withColumn("text", F.upper("text"))
    return quality.edits(lines, answers, ["scan_id", "photo", "line_no"])


@query("SELECT source, count(*) AS n, avg(CASE WHEN lang = 'en' THEN 1.0 ELSE 0.0 END) AS accuracy FROM documents GROUP BY source")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    docs = A.table(spark, d, "documents").select("source", F.lit("en").alias("predicted"), F.col("lang").alias("gold"))
    return quality.accuracy(docs, "source")


@query(over("line", "SELECT scan_id, photo, line_no, CASE WHEN line_no % 2 = 0 THEN 'mrp' ELSE 'other' END AS vote_class, CASE WHEN line_no % 2 = 0 THEN 0.8 ELSE 0.0 END AS vote_prob FROM line"))
def votes_or_none(spark: SparkSession, d: str) -> DataFrame:
    keys = ["scan_id", "photo", "line_no"]
    lines = A.label_lines(spark, d).select(*keys)
    votes = lines.where("line_no % 2 = 0").withColumns({"vote_class": F.lit("mrp"), "vote_prob": F.lit(0.8)})
    return quality.votes_or_none(lines, votes, keys)


def boxed(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("scan_id") + F.col("line_no")
    return A.label_lines(spark, d).drop("block_no").withColumns({"x1": (k % 3) * 300.0, "x2": (k % 3) * 300.0 + 100 + (k % 4) * 200, "y1": F.col("line_no") * 40.0 + (k % 5) * 8, "y2": F.col("line_no") * 40.0 + 20, "med": F.lit(20.0), "img_h": F.lit(1000.0)})


BOXED = "bx AS (SELECT scan_id, photo, line_no, text, top, (k % 3) * 300.0::DOUBLE AS x1, (k % 3) * 300.0::DOUBLE + 100 + (k % 4) * 200 AS x2, line_no * 40.0::DOUBLE + (k % 5) * 8 AS y1, line_no * 40.0::DOUBLE + 20 AS y2 FROM (SELECT *, scan_id + line_no AS k FROM line))"
SPLIT = f"""{BOXED}, pv AS (SELECT *, lag(x1) OVER w AS px1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM bx WINDOW w AS (PARTITION BY scan_id, photo ORDER BY line_no)),
 b AS (SELECT *, sum(CASE WHEN px1 IS NULL THEN 0 WHEN y1 - py2 > 32 OR greatest(0, least(x2, px2) - greatest(x1, px1)) / least(x2 - x1, px2 - px1) <= 0.15::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id, photo ORDER BY line_no)::INTEGER AS block_no FROM pv)"""


@query(over("line", "").rstrip() + f", {SPLIT} SELECT scan_id, photo, line_no, block_no FROM b")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    return layout.blocks(boxed(spark, d)).select("scan_id", "photo", "line_no", "block_no")


@query(over("line", "").rstrip() + f""", {SPLIT}, t AS (SELECT scan_id, photo, block_no, lower(string_agg(text, chr(10) ORDER BY line_no)) AS t, min_by(top, line_no) AS top, count(*) AS n FROM b GROUP BY ALL)
 SELECT scan_id, photo, block_no, CASE WHEN regexp_matches(t, 'ingred') THEN 'ingredients' WHEN regexp_matches(t, 'nutrition|per 100 ?g|kcal|protein') THEN 'nutrition' WHEN regexp_matches(t, 'manufactured|marketed|packed|imported|mfd |mkt |brand owned') THEN 'manufacturer'
  WHEN regexp_matches(t, 'consumer care|customer care|complaint|helpline|toll free|customercare') THEN 'consumerCare' WHEN regexp_matches(t, 'batch|lot no|date of mfg|use by|best before|\\bmrp\\b|maximum retail') THEN 'variable'
  WHEN regexp_matches(t, '^\\s*[0-9 ]{{8,}}\\s*$') AND n <= 2 THEN 'barcode' WHEN top < 0.35::DOUBLE THEN 'identity' ELSE 'unknown' END AS hint FROM t""".replace("{{", "{").replace("}}", "}"))
def block_hint(spark: SparkSession, d: str) -> DataFrame:
    return layout.hints(layout.blocks(boxed(spark, d)))


@query(over("line", "SELECT scan_id, string_agg(t, chr(10) || chr(10) ORDER BY block_no) AS combined_text FROM (SELECT scan_id, block_no, string_agg(text, chr(10) ORDER BY line_no) AS t FROM line GROUP BY ALL) GROUP BY scan_id"))
def combined_text(spark: SparkSession, d: str) -> DataFrame:
    return layout.combined_text(A.label_lines(spark, d))


@query(over("line", "SELECT scan_id, photo, line_no, CASE WHEN line_no = 3 AND scan_id % 4 = 0 THEN 'MRP Rs. ' || scan_id::VARCHAR ELSE text END AS text, conf FROM line"))
def apply_line_edits(spark: SparkSession, d: str) -> DataFrame:
    lines = A.label_lines(spark, d)
    edits = A.table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("scan_id"), F.lit(0).alias("photo"), F.lit(3).alias("line_no"), F.concat(F.lit("MRP Rs. "), F.col("p_partkey").cast("string")).alias("edit"))
    return layout.edited(lines, edits).select("scan_id", "photo", "line_no", "text", "conf")


# --- classifier

GRAMS = """w AS (SELECT scan_id, line_no, ' ' || unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) || ' ' AS p FROM line),
 g AS (SELECT scan_id, line_no, n, p, unnest(range(1, greatest(length(p) - n + 2, 1)::BIGINT)) AS i FROM w, (VALUES (3), (4), (5)) AS s(n)),
 c AS (SELECT scan_id, line_no, substr(p, i, n) AS gram, count(*) AS n FROM g WHERE length(p) >= n GROUP BY ALL)"""


@query(over("line", "").rstrip() + f", {GRAMS} SELECT * FROM c")
def ngram_features(spark: SparkSession, d: str) -> DataFrame:
    return classify.counted(A.label_lines(spark, d), "scan_id", "line_no")


#: A small model by hand, for the query: gram, idf, weights of the classes mrp, net_qty and batch.
MODEL = [("mrp", 1.5, 2.0, -1.0, -1.0), (" rs.", 1.2, 1.5, 0.0, 0.0), ("net", 1.1, -1.0, 2.5, -0.5), ("qty", 1.4, -0.5, 2.0, 0.0), ("bat", 1.3, -1.0, -1.0, 2.2), ("lot", 1.6, 0.0, -0.5, 2.0), (" no", 1.0, 0.1, 0.2, 1.0), ("tax", 1.7, 1.1, 0.0, 0.0)]
BIAS = [(0, "mrp", 0.1), (1, "net_qty", 0.0), (2, "batch", -0.1)]
_model = ", ".join(f"('{g}', {i}::DOUBLE, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for g, i, a, b, c in MODEL)


@query(
    over("line", "").rstrip()
    + f""", {GRAMS}, m(gram, idf, w0, w1, w2) AS (VALUES {_model}), v AS (SELECT scan_id, line_no, c.n * idf AS v, w0, w1, w2 FROM c JOIN m USING (gram)),
 s AS (SELECT scan_id, line_no, sqrt(sum(v * v)) AS norm, sum(v * w0) AS s0, sum(v * w1) AS s1, sum(v * w2) AS s2 FROM v GROUP BY ALL),
 z AS (SELECT l.scan_id, l.line_no, 0.1::DOUBLE + coalesce(s0 / norm, 0) AS z0, coalesce(s1 / norm, 0) AS z1, coalesce(s2 / norm, 0) - 0.1::DOUBLE AS z2 FROM line l LEFT JOIN s ON l.scan_id = s.scan_id AND l.line_no = s.line_no )
 SELECT scan_id, line_no, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 'mrp' WHEN z1 >= z2 THEN 'net_qty' ELSE 'batch' END AS vote_class, round(exp(greatest(z0, z1, z2)) / (exp(z0) + exp(z1) + exp(z2)), 6) AS vote_prob FROM z"""
)
def ngram_score(spark: SparkSession, d: str) -> DataFrame:
    idf = spark.createDataFrame([(g, i) for g, i, *_ in MODEL], "gram string, idf double")
    weights = spark.createDataFrame([(k, row[0], row[2 + k]) for row in MODEL for k in range(3)], "class_no int, gram string, weight double")
    bias = spark.createDataFrame(BIAS, "class_no int, class string, bias double")
    df = classify.scored(A.label_lines(spark, d), idf, weights, bias, "scan_id", "line_no")
    return df.withColumn("vote_prob", F.round("vote_prob", 6))


# --- second reading


def label_only(spark: SparkSession, d: str) -> DataFrame:
    o = A.observations(spark, d).dropDuplicates(["scan_id", "photo_index", "field"]).select("scan_id", F.col("photo_index").alias("photo"), "field")
    k = F.col("scan_id") + F.col("photo") * 3
    return o.select("scan_id", "photo", "field", F.when(k % 3 == 0, "found").otherwise("unverified").alias("status"), F.when(k % 2 == 0, "label_only").otherwise("nearby").alias("relationship"), (k % 80 / 100).alias("x1"), (k % 90 / 100).alias("y1"), (k % 80 / 100 + 0.1).alias("x2"), (k % 90 / 100 + 0.02).alias("y2"))


TARGETS = "t AS (SELECT scan_id, photo, field, (k % 80)::DOUBLE / 100 AS x1, (k % 90)::DOUBLE / 100 AS y1, (k % 90)::DOUBLE / 100 + 0.02::DOUBLE AS y2 FROM (SELECT DISTINCT scan_id, photo_index AS photo, field, scan_id + photo_index * 3 AS k FROM obs) WHERE k % 3 <> 0 AND k % 2 = 0 AND field IN ('batch', 'mrp', 'mfg', 'exp'))"


@query(over("obs", "").rstrip() + f", {TARGETS} SELECT scan_id, photo, field FROM t")
def reread_targets(spark: SparkSession, d: str) -> DataFrame:
    return reread.targets(label_only(spark, d)).select("scan_id", "photo", "field")


JOBS = f"""{TARGETS}, r AS (SELECT *, greatest(0.0::DOUBLE, x1 - 0.01::DOUBLE) AS rx1, greatest(0.0::DOUBLE, y1 - 0.015::DOUBLE) AS ry1, least(1.0::DOUBLE, y2 + 0.09::DOUBLE) AS ry2 FROM t),
 a AS (SELECT *, round((1.0::DOUBLE - rx1) * (ry2 - ry1), 9) AS area FROM r)"""


@query(over("obs", "").rstrip() + f", {JOBS} SELECT scan_id, photo, field, job_no FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY area, photo, field)::INTEGER AS job_no FROM a) WHERE job_no <= 4")
def reread_job_plan(spark: SparkSession, d: str) -> DataFrame:
    return reread.job_plan(reread.search_rect(reread.targets(label_only(spark, d)))).select("scan_id", "photo", "field", "job_no")


CROPS = f"""{JOBS}, p AS (SELECT scan_id, photo, field, w, h, floor(rx1 * w + 0.5::DOUBLE)::BIGINT AS l, floor(ry1 * h + 0.5::DOUBLE)::BIGINT AS t, floor((1.0::DOUBLE - rx1) * w + 0.5::DOUBLE)::BIGINT AS cw, floor((ry2 - ry1) * h + 0.5::DOUBLE)::BIGINT AS ch
  FROM (SELECT *, 50 + scan_id % 5 * 900 AS w, 40 + scan_id % 3 * 1500 AS h FROM a)),
 c AS (SELECT scan_id, photo, field, least(l, w - 1) AS l, least(t, h - 1) AS t, least(cw, w - l) AS cw, least(ch, h - t) AS ch FROM p WHERE cw >= 8 AND ch >= 8 AND w - l >= 8 AND h - t >= 8),
 u AS (SELECT c.*, v, name, (SELECT max(s) FROM range(1, most + 1) r(s) WHERE s = 1 OR cw * s * ch * s <= 1600000) AS scale FROM c, (VALUES (0, 'plain', 3), (1, 'contrast', 3), (2, 'highContrast', 4)) x(v, name, most))
 SELECT scan_id, photo, field, v AS variant, l::INTEGER AS "left", t::INTEGER AS top, cw::INTEGER AS width, ch::INTEGER AS height, scale::INTEGER AS scale, CASE WHEN name = 'highContrast' AND scale < 3 THEN 'plain' ELSE name END AS prepared FROM u"""


@query(over("obs", "").rstrip() + f", {CROPS}")
def reread_crops(spark: SparkSession, d: str) -> DataFrame:
    """Where and how each label's crop is cut from photos of several sizes, some too small to read."""
    rects = reread.search_rect(reread.targets(label_only(spark, d))).withColumns({"img_w": 50 + F.col("scan_id") % 5 * 900, "img_h": 40 + F.col("scan_id") % 3 * 1500})
    return reread.crops(rects).select("scan_id", "photo", "field", "variant", "left", "top", "width", "height", "scale", "prepared")


@query("SELECT l_orderkey AS scan_id, f AS field, max(v) AS value, max(c) AS confidence FROM (SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'mrp' WHEN 1 THEN 'batch' ELSE 'exp' END AS f, CASE l_orderkey % 3 WHEN 0 THEN '1250.50' WHEN 1 THEN 'B' || l_orderkey::VARCHAR || 'X9' ELSE '12/05/2027' END AS v, floor(CASE l_orderkey % 3 WHEN 1 THEN 0.9::DOUBLE ELSE 0.95::DOUBLE END * (0.55::DOUBLE + 0.45::DOUBLE * ((l_orderkey + l_linenumber) % 50)::DOUBLE / 50) * 100 + 0.5::DOUBLE) / 100 AS c FROM lineitem) GROUP BY ALL")
def reread_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    text = F.when(k % 3 == 0, "Rs. 1,250.50 (0.5/g)").when(k % 3 == 1, F.concat(F.lit("No "), F.lit("B"), k.cast("string"), F.lit("X9"))).otherwise("exp 12/05/2027")
    rows = A.table(spark, d, "lineitem").select(k.alias("scan_id"), F.when(k % 3 == 0, "mrp").when(k % 3 == 1, "batch").otherwise("exp").alias("field"), text.alias("text"), ((k + F.col("l_linenumber")) % 50 / 50).alias("conf"), F.lit(0).alias("job_no"), F.col("l_linenumber").cast("int").alias("variant"))
    return reread.winners(rows).select("scan_id", "field", "value", "confidence")


# --- streaming


@query(over("outbox", "SELECT id, created_at, officer_id, kind FROM outbox WHERE NOT synced"))
def outbox_drain_stream(spark: SparkSession, d: str) -> DataFrame:
    """The pending rows after a stream over the landed events has been drained into a table."""
    at = f"{scratch.shared_dir(spark)}/packlens/outbox-{uuid.uuid4().hex}"
    schema = A.table(spark, d, "events").schema
    # the source watches a folder: the table's own, or the one that holds its file
    folder, glob = (d, "events.parquet") if scratch.is_file(spark, f"{d}/events.parquet") else (f"{d}/events.parquet", "*.parquet")
    raw = stream.landed(spark, folder, schema, glob)
    events = raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("user_id").alias("officer_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 3 != 0).alias("synced"))
    stream.drained(events, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    if not scratch.folders(spark, f"{at}/table"):
        return spark.createDataFrame([], "id long, created_at timestamp_ntz, officer_id long, kind string")
    return spark.read.option("basePath", f"{at}/table").parquet(f"{at}/table").select("id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "officer_id", "kind")
