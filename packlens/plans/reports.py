"""Queries of reporting, validation, ingest and rules over the test tables, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packlens.functions import vocab
from packlens.operators import findings, merge, quality, reporting, rules, validation
from packlens.sources import adapters as A
from packlens.sources import changes
from packlens.sources.adapters import over

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(1997, 6, 1)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- dashboard

COUNTS = "count(*) AS total, count(*) FILTER (WHERE verdict = 'compliant') AS compliant, count(*) FILTER (WHERE verdict = 'nonCompliant') AS \"nonCompliant\", count(*) FILTER (WHERE verdict = 'needsReview') AS \"needsReview\""


@query(over("scan", f"SELECT {COUNTS} FROM scan"))
def dashboard_verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return reporting.verdict_counts(A.scans(spark, d))


@query(over("scan", "SELECT total, CASE WHEN total > 0 THEN c::DOUBLE / total ELSE 0 END AS pass_rate, floor(c::DOUBLE / greatest(total, 1) * 100 + 0.5::DOUBLE)::BIGINT AS pass_percent FROM (SELECT count(*) AS total, count(*) FILTER (WHERE verdict = 'compliant') AS c FROM scan)"))
def dashboard_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    return reporting.pass_rate(A.scans(spark, d))


TOP = "SELECT code, count(*) AS n FROM rr WHERE status = 'fail' GROUP BY code ORDER BY n DESC, code LIMIT 8"


@query(over("rr", TOP))
def dashboard_top_violations(spark: SparkSession, d: str) -> DataFrame:
    return reporting.top_violations(A.rule_results(spark, d))


@query(over("rr", f"SELECT code, n, floor(n::DOUBLE / greatest(max(n) OVER (), 1) * 100 + 0.5::DOUBLE)::BIGINT AS percent FROM ({TOP})"))
def top_violations_scaled(spark: SparkSession, d: str) -> DataFrame:
    return reporting.scaled(reporting.top_violations(A.rule_results(spark, d)))


@query(over("scan", "SELECT id, product_name, verdict, score FROM scan ORDER BY created_at DESC, id LIMIT 10"))
def dashboard_recent(spark: SparkSession, d: str) -> DataFrame:
    return reporting.recent(A.scans(spark, d))


# --- lists and search

PAGE = "id, product_name, category, verdict, score, photo_count, created_at, officer_id"


@query(over("scan", f"SELECT {PAGE} FROM scan WHERE verdict = 'needsReview' AND category = 'food' ORDER BY created_at DESC, id LIMIT 25 OFFSET 50"))
def scan_list_page(spark: SparkSession, d: str) -> DataFrame:
    return reporting.page_of(reporting.filtered(A.scans(spark, d), "needsReview", "Food"), "3", 25)


@query(over("scan", f"SELECT {PAGE} FROM scan ORDER BY created_at DESC, id LIMIT 20"))
def scan_list_unknown_filters(spark: SparkSession, d: str) -> DataFrame:
    return reporting.page_of(reporting.filtered(A.scans(spark, d), "bogus", "toys"), "x", "NaN")


@query(over("scan", "SELECT count(*) AS total FROM scan WHERE verdict = 'nonCompliant' AND category = 'general'"))
def scan_list_filtered_count(spark: SparkSession, d: str) -> DataFrame:
    return reporting.filtered(A.scans(spark, d), "nonCompliant", "general").agg(F.count("*").alias("total"))


@query(over("scan", "SELECT count(*) AS total, greatest(1, ceil(count(*)::DOUBLE / 100))::BIGINT AS pages FROM scan WHERE category = 'food'"))
def scan_page_count(spark: SparkSession, d: str) -> DataFrame:
    return reporting.page_count(reporting.filtered(A.scans(spark, d), None, "food"), 500)


@query(over("scan rr", "SELECT id, product_name, verdict FROM scan WHERE id IN (SELECT scan_id FROM rr WHERE code = 'LM-R6-MRP' AND status = 'fail')"))
def scan_by_rule(spark: SparkSession, d: str) -> DataFrame:
    return reporting.with_rule(A.scans(spark, d), A.rule_results(spark, d), "LM-R6-MRP").select("id", "product_name", "verdict")


@query(over("scan usr", "SELECT id, product_name, category, verdict, score, created_at, officer_id, user_name, email, role FROM scan LEFT JOIN usr ON officer_id = user_id"))
def scan_detail_with_officer(spark: SparkSession, d: str) -> DataFrame:
    df = reporting.with_officer(A.scans(spark, d), A.users(spark, d))
    return df.select("id", "product_name", "category", "verdict", "score", "created_at", "officer_id", "user_name", "email", "role")


@query(over("scan usr", "SELECT id, coalesce(user_name, CASE WHEN id % 2 = 0 THEN 'Officer ' || officer_id::VARCHAR END, '—') AS officer FROM scan LEFT JOIN (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN user_name END AS user_name FROM usr) ON officer_id = user_id"))
def report_officer_fallback(spark: SparkSession, d: str) -> DataFrame:
    df = reporting.with_officer(A.scans(spark, d), A.users(spark, d).withColumn("user_name", F.when(F.col("user_id") % 3 == 0, F.col("user_name"))))
    own = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Officer "), F.col("officer_id").cast("string")))
    return df.select("id", reporting.officer_label(F.col("user_name"), own).alias("officer"))


@query(over("usr", "SELECT user_id, user_name, email, role FROM usr"))
def users_without_hash(spark: SparkSession, d: str) -> DataFrame:
    return A.users(spark, d).drop("password_hash")


@query(over("scan", "SELECT id, product_name, verdict, category FROM scan WHERE contains(lower(product_name), 'uct 77') OR contains(lower(verdict), 'uct 77') OR contains(lower(category), 'uct 77')"))
def device_search(spark: SparkSession, d: str) -> DataFrame:
    return reporting.device_search(A.scans(spark, d), "  UCT 77 ").select("id", "product_name", "verdict", "category")


TERMS = "list_distinct(list_transform(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END))"


@query(f"SELECT doc_id FROM (SELECT doc_id, text, {TERMS.format('text')} AS t FROM documents) WHERE list_has_any(t, ['license', 'password']) AND NOT list_has_any(t, ['apache']) AND contains(lower(text), 'under')")
def text_search_any_term(spark: SparkSession, d: str) -> DataFrame:
    return reporting.search_any_term(A.table(spark, d, "documents"), 'the licenses password -Apache "under"', F.col("text")).select("doc_id")


@query("SELECT page_id, CASE WHEN u IS NULL OR u = '' THEN '' WHEN regexp_matches(u, '^(?i)https?://') THEN u ELSE 'https://files.example/api' || CASE WHEN u[1] = '/' THEN u ELSE '/' || u END END AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '/up/' || page_id::VARCHAR || '.jpg' WHEN 2 THEN 'up/' || page_id::VARCHAR ELSE url END AS u FROM pages)")
def url_absolutize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    s = k.cast("string")
    u = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat(F.lit("/up/"), s, F.lit(".jpg"))).when(k % 4 == 2, F.concat(F.lit("up/"), s)).otherwise(F.col("url"))
    return A.table(spark, d, "pages").select("page_id", reporting.absolute_url(u, "https://files.example/api/").alias("url"))


# --- the flat sheet

FIRST_OBS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, field ORDER BY CASE status WHEN 'found' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END DESC, confidence DESC, photo_index, value) AS rn FROM obs) WHERE rn = 1)"
AGG_CODES = """SELECT scan_id, count(*) FILTER (WHERE status = 'fail') AS fail_count, count(*) FILTER (WHERE status = 'warning') AS warning_count,
 count(*) FILTER (WHERE status = 'manualReview') AS review_count, count(*) FILTER (WHERE status = 'unverified') AS unverified_count, count(*) FILTER (WHERE status = 'pass') AS pass_count,
 coalesce(string_agg(code, ';' ORDER BY rule_seq) FILTER (WHERE status = 'fail'), '') AS failed_rule_codes,
 coalesce(string_agg(code, ';' ORDER BY rule_seq) FILTER (WHERE status = 'unverified'), '') AS unverified_rule_codes FROM rr GROUP BY scan_id"""


@query(over("rr", AGG_CODES))
def csv_failed_codes(spark: SparkSession, d: str) -> DataFrame:
    return reporting.rule_summary(A.rule_results(spark, d))


_value = {"generic_name": "genericName", "brand": "brand", "net_qty_raw": "netQty", "mrp_raw": "mrp", "mfg_raw": "mfg", "exp_raw": "exp", "manufacturer_name": "manufacturer", "care_phone": "carePhone", "care_email": "careEmail", "country_of_origin": "origin", "batch_no": "batch", "fssai_lic": "fssai"}
_pivot = ", ".join(f"max(value) FILTER (WHERE field = '{f}') AS {c}" for c, f in _value.items())


@query(
    over(
        "scan rr obs",
        f"""SELECT id::VARCHAR AS id, product_name, category, strftime(created_at, '%Y-%m-%dT%H:%M:%S.') || '000Z' AS scanned_at, verdict, score::VARCHAR AS score, photo_count::VARCHAR AS photo_count,
 region_count::VARCHAR AS region_count, {", ".join(f"coalesce(p.{c}, '') AS {c}" for c in _value)}, coalesce(CASE WHEN p.m THEN p.m_qty END, '') AS net_qty_value, CASE WHEN p.m THEN 'g' ELSE '' END AS net_qty_unit,
 printf('%.2f', mean_confidence) AS mean_confidence, '' AS mrp_value, 'no' AS mrp_tax_phrase, '' AS manufacturer_address, '' AS photo_paths,
 coalesce(fail_count, 0)::VARCHAR AS fail_count, coalesce(warning_count, 0)::VARCHAR AS warning_count, coalesce(review_count, 0)::VARCHAR AS review_count,
 coalesce(failed_rule_codes, '') AS failed_rule_codes, coalesce(unverified_rule_codes, '') AS unverified_rule_codes
 FROM scan LEFT JOIN (SELECT scan_id, {_pivot}, bool_or(field = 'netQty') AS m, max(substr(value, 2)) FILTER (WHERE field = 'netQty') AS m_qty FROM {FIRST_OBS} GROUP BY scan_id) p ON id = p.scan_id LEFT JOIN ({AGG_CODES}) r ON id = r.scan_id""",
    )
)
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    best = merge.merged(A.observations(spark, d))
    data = F.when(F.col("field") == "netQty", F.create_map(F.lit("value"), F.expr("substr(value, 2)"), F.lit("unit"), F.lit("g"))).otherwise(F.create_map().cast("map<string,string>"))
    df = reporting.sheet(A.scans(spark, d), best.withColumn("data", data), reporting.rule_summary(A.rule_results(spark, d)))
    return df


def _quoted(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[\",\\n\\r]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query("SELECT concat_ws(',', " + ", ".join(_quoted(f"coalesce({c}, '')") for c in vocab.SHEET) + f") AS line FROM ({ORACLE_SQL['csv_rows']})")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return reporting.csv_lines(csv_rows(spark, d))


@query("SELECT p_partkey AS id, coalesce(nullif(lower(regexp_replace(trim(regexp_replace(p_name || ' (' || p_brand || '), \"x\"', '[^A-Za-z0-9_ -]+', '', 'g')), ' +', '_', 'g')), ''), 'product') || '_' || p_partkey || '.csv' AS name FROM part")
def export_names(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit('), "x"'))
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), reporting.export_name(name, F.col("p_partkey")).alias("name"))


@query(
    """WITH photo AS (SELECT l_orderkey AS scan_id, CASE WHEN l_linestatus = 'F' THEN l_discount * 10 END AS mean_conf, CASE WHEN l_linestatus = 'F' THEN l_quantity::BIGINT END AS chars, CASE WHEN l_linestatus = 'F' THEN l_linenumber::BIGINT END AS regions FROM lineitem)
 SELECT scan_id, floor(sum(coalesce(mean_conf, 0)::DECIMAL(38,12))::DOUBLE / count(*) * 1000 + 0.5) AS mean_confidence, coalesce(sum(chars), 0)::BIGINT AS total_chars, coalesce(sum(regions), 0)::BIGINT AS region_count, count(*) AS photo_count FROM photo GROUP BY scan_id"""
)
def capture_quality(spark: SparkSession, d: str) -> DataFrame:
    read = F.col("l_linestatus") == "F"
    photos = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("scan_id"), F.when(read, F.col("l_discount") * 10).alias("mean_conf"), F.when(read, F.col("l_quantity").cast("long")).alias("chars"), F.when(read, F.col("l_linenumber").cast("long")).alias("regions"))
    return quality.capture_quality(photos).withColumn("mean_confidence", F.floor(F.col("mean_confidence") * 1000 + 0.5).cast("double"))


@query(over("scan rr", "SELECT id, category, verdict, coalesce(n, 0) AS failed FROM scan LEFT JOIN (SELECT scan_id, count(*) AS n FROM rr WHERE status = 'fail' GROUP BY scan_id) ON id = scan_id WHERE verdict = 'nonCompliant' AND category = 'food' ORDER BY created_at DESC, id LIMIT 10000"))
def csv_filtered(spark: SparkSession, d: str) -> DataFrame:
    failed = A.rule_results(spark, d).where("status = 'fail'").groupBy(F.col("scan_id").alias("id")).agg(F.count("*").alias("failed"))
    s = A.scans(spark, d).where((F.col("verdict") == "nonCompliant") & (F.col("category") == "food")).orderBy(F.desc("created_at"), "id").limit(10_000)
    return s.join(failed, "id", "left").select("id", "category", "verdict", F.coalesce("failed", F.lit(0)).alias("failed"))


# --- validation

ERRORS = """SELECT order_id, line_no, mrp, status_key, unnest(list_filter([
 CASE WHEN coalesce(productName, '') = '' THEN 'REQUIRED_FIELD:productName' END, CASE WHEN coalesce(category, '') = '' THEN 'REQUIRED_FIELD:category' END,
 CASE WHEN NOT has_manufacturer THEN 'REQUIRED_FIELD:manufacturer' END, 'REQUIRED_FIELD:netQty', CASE WHEN list_contains(requiredFields, 'fssai') THEN 'REQUIRED_FIELD:fssai' END,
 CASE WHEN mrp_text THEN 'PRICE_TYPE:mrp' END, CASE WHEN mrp <= 0 THEN 'PRICE_002:mrp' END, CASE WHEN sellingPrice > mrp THEN 'PRICE_001:sellingPrice' END,
 CASE WHEN expiryDate <= manufacturingDate THEN 'DATE_001:expiryDate' END, CASE WHEN expiryDate < TIMESTAMP '1997-06-01' THEN 'DATE_002:expiryDate' END,
 CASE WHEN has_manufacturer AND coalesce(m_name, '') = '' THEN 'MANUFACTURER_001:manufacturer.name' END,
 CASE WHEN has_manufacturer AND coalesce(m_address, '') = '' THEN 'MANUFACTURER_002:manufacturer.address' END], lambda x: x IS NOT NULL)) AS e
 FROM (SELECT p.*, r.requiredFields, row_number() OVER () AS status_key FROM product p JOIN regulation r ON lower(p.category) = r.category)"""


@query(over("product regulation", f"SELECT string_split(e, ':')[1] AS rule_code, string_split(e, ':')[2] AS field, count(*) AS n, sum(order_id * 7 + line_no)::BIGINT AS keys FROM ({ERRORS}) GROUP BY ALL"))
def product_validation_errors(spark: SparkSession, d: str) -> DataFrame:
    checked = validation.validated(A.products(spark, d), A.regulations(spark), NOW)
    rows = validation.error_rows(checked, "order_id", "line_no")
    return rows.groupBy("rule_code", "field").agg(F.count("*").alias("n"), F.sum(F.col("order_id") * 7 + F.col("line_no")).alias("keys"))


@query(over("product regulation", f"SELECT order_id, line_no, 'FAIL' AS status, greatest(0, 100 - 10 * count(*))::BIGINT AS score, count(*)::INTEGER AS n_errors FROM ({ERRORS}) GROUP BY status_key, order_id, line_no"))
def product_validation_status(spark: SparkSession, d: str) -> DataFrame:
    checked = validation.validated(A.products(spark, d), A.regulations(spark), NOW)
    return checked.select("order_id", "line_no", "status", "score", F.size("errors").alias("n_errors"))


@query(over("product regulation", "SELECT category, count(*) AS n FROM product WHERE lower(category) NOT IN (SELECT category FROM regulation) GROUP BY category"))
def product_unmatched_category(spark: SparkSession, d: str) -> DataFrame:
    return validation.without_regulation(A.products(spark, d), A.regulations(spark)).groupBy("category").agg(F.count("*").alias("n"))


@query(over("scan", "SELECT id, created_at, score, p_name AS product_name, p_brand AS brand FROM (SELECT *, id % 250 AS part FROM scan) LEFT JOIN part ON part = p_partkey ORDER BY created_at DESC, id LIMIT 200"))
def validation_history(spark: SparkSession, d: str) -> DataFrame:
    s = A.scans(spark, d).withColumn("p_partkey", F.col("id") % 250)
    p = A.table(spark, d, "part").select("p_partkey", F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand")).alias("product"))
    return s.orderBy(F.desc("created_at"), "id").limit(200).join(p, "p_partkey", "left").select("id", "created_at", "score", F.col("product.name").alias("product_name"), F.col("product.brand").alias("brand"))


# --- ingest

RAW = """SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE ' ' || text END AS product_name, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'FOOD' WHEN 2 THEN 'toys' ELSE 'general' END AS category,
 CASE doc_id % 3 WHEN 0 THEN 'compliant' WHEN 1 THEN 'oops' END AS verdict, CASE WHEN doc_id % 4 = 0 THEN 'NaNa' ELSE n_chars::VARCHAR END AS score, CASE WHEN doc_id % 2 = 0 THEN '0' ELSE (doc_id % 8)::VARCHAR END AS photo_count,
 '0.' || (doc_id % 100)::VARCHAR AS mean_confidence, CASE WHEN doc_id % 7 <> 0 THEN '12.5' END AS lat, CASE WHEN doc_id % 6 <> 0 THEN '77.' || doc_id::VARCHAR END AS lng FROM documents"""


def raw_scans(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("doc_id"), F.col("doc_id").cast("string")
    return A.table(spark, d, "documents").select(
        k.alias("id"),
        F.when(k % 9 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("text"))).alias("product_name"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "FOOD").when(k % 5 == 2, "toys").otherwise("general").alias("category"),
        F.when(k % 3 == 0, "compliant").when(k % 3 == 1, "oops").alias("verdict"),
        F.when(k % 4 == 0, "NaNa").otherwise(F.col("n_chars").cast("string")).alias("score"),
        F.when(k % 2 == 0, "0").otherwise((k % 8).cast("string")).alias("photo_count"),
        F.concat(F.lit("0."), (k % 100).cast("string")).alias("mean_confidence"),
        F.when(k % 7 != 0, "12.5").alias("lat"),
        F.when(k % 6 != 0, F.concat(F.lit("77."), s)).alias("lng"),
    )


CLEAN = f"""SELECT *, named AND known_category AS accepted FROM (SELECT id, trim(product_name) AS product_name, lower(coalesce(nullif(trim(category), ''), 'general')) AS category,
 CASE WHEN verdict IN ('compliant', 'nonCompliant', 'needsReview') THEN verdict ELSE 'needsReview' END AS verdict, coalesce(try_cast(score AS DOUBLE), 0) AS score,
 greatest(1, coalesce(try_cast(photo_count AS INTEGER), 0)) AS photo_count, coalesce(try_cast(mean_confidence AS DOUBLE), 0) AS mean_confidence,
 CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN lat::DOUBLE END AS lat, CASE WHEN lat IS NOT NULL AND lng IS NOT NULL THEN lng::DOUBLE END AS lng,
 coalesce(trim(product_name), '') <> '' AS named, lower(coalesce(nullif(trim(category), ''), 'general')) IN ('general', 'food') AS known_category FROM ({RAW}))"""


@query(f"SELECT * EXCLUDE (named, known_category, accepted) FROM ({CLEAN}) WHERE accepted")
def ingest_normalise(spark: SparkSession, d: str) -> DataFrame:
    return validation.ingested(raw_scans(spark, d)).where("accepted").drop("named", "known_category", "accepted")


@query(f"SELECT id, CASE WHEN NOT named THEN 'productName' ELSE 'category' END AS reason FROM ({CLEAN}) WHERE NOT accepted")
def ingest_rejects(spark: SparkSession, d: str) -> DataFrame:
    return validation.ingested(raw_scans(spark, d)).where("not accepted").select("id", F.when(~F.col("named"), "productName").otherwise("category").alias("reason"))


@query(
    "SELECT scan_id, n_files, n_bytes, reason IS NULL AS accepted, reason FROM (SELECT k AS scan_id, count(*) AS n_files, sum(b)::BIGINT AS n_bytes, "
    "CASE WHEN bool_or(m NOT LIKE 'image/%') THEN 'not_image' WHEN max(b) > 12582912 THEN 'too_large' WHEN count(*) > 8 THEN 'too_many' END AS reason "
    "FROM (SELECT l_orderkey // 3 AS k, floor(l_extendedprice)::BIGINT * 250 AS b, CASE l_suppkey % 40 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'image/png' ELSE 'image/jpeg' END AS m FROM lineitem) GROUP BY k)"
)
def upload_limits(spark: SparkSession, d: str) -> DataFrame:
    """Uploads of photos that keep to the limits, and why the others don't."""
    mime = F.when(F.col("l_suppkey") % 40 == 0, "text/plain").when(F.col("l_suppkey") % 40 == 1, "image/png").otherwise("image/jpeg")
    files = A.table(spark, d, "lineitem").select(F.floor(F.col("l_orderkey") / 3).cast("long").alias("scan_id"), mime.alias("mime"), (F.floor("l_extendedprice").cast("long") * 250).alias("bytes"))
    return validation.uploads(files)


@query(over("outbox", "SELECT id, created_at, officer_id, kind, synced OR id % 4 = 1 AS synced FROM outbox WHERE NOT (id % 10 = 7) UNION ALL SELECT -id, created_at, officer_id, 'copy', false FROM outbox WHERE id % 50 = 0 AND id <> 0 UNION ALL SELECT id, created_at, officer_id, 'late', NULL FROM outbox WHERE id % 10 = 7 AND id % 4 = 1"))
def outbox_changes(spark: SparkSession, d: str) -> DataFrame:
    """The outbox after rows were marked as sent, some deleted, and others put in."""
    box, k = A.outbox(spark, d), F.col("id")
    sent = changes.updated(box, box.where(k % 4 == 1).select("id", F.lit(True).alias("synced")), "id")
    left = changes.removed(sent, box.where(k % 10 == 7), "id")
    copies = box.where((k % 50 == 0) & (k != 0)).withColumns({"id": -k, "kind": F.lit("copy"), "synced": F.lit(False)})
    late = box.where((k % 10 == 7) & (k % 4 == 1)).select("id", "created_at", "officer_id", F.lit("late").alias("kind"))
    return changes.upserted(changes.upserted(left, copies, "id"), late, "id")


# --- rules and merging

QUALITY = "(SELECT id, category, mean_confidence, region_count >= 8 AND mean_confidence >= 0.55::DOUBLE AND id % 400 >= 150 AS adequate FROM scan)"


@query(over("scan", f"SELECT id, adequate FROM {QUALITY}"))
def quality_adequacy(spark: SparkSession, d: str) -> DataFrame:
    return rules.adequate(A.scans(spark, d).withColumn("total_chars", F.col("id") % 400)).select("id", "adequate")


def rule_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    scans = A.scans(spark, d).withColumn("total_chars", F.col("id") % 400)
    best = merge.merged(A.observations(spark, d))
    data = F.create_map(F.lit("address"), F.concat(F.lit("Plot "), F.col("value")), F.lit("role"), F.when(F.col("photo_index") == 1, "importer").otherwise("manufacturer"))
    text = F.concat(F.lit("MRP "), F.when(F.col("id") % 3 == 0, "and m.r.p. Inclusive of  all taxes").otherwise("imported"))
    return scans.withColumn("ocr_text", text), best.withColumn("data", data)


def rule_rows(spark: SparkSession, d: str) -> DataFrame:
    return rules.evaluated(*rule_inputs(spark, d))


_obs = ", ".join(f"max(status) FILTER (WHERE field = '{f}') AS {f}" for f in vocab.FIELDS)
RULE_SQL = f"""SELECT id, seq, code, status, severity FROM (
 SELECT id, unnest(range(14)) AS seq, unnest([{", ".join(f"'{c}'" for c in vocab.CODES)}]) AS code, unnest([
  CASE coalesce(manufacturer, 'notFound') WHEN 'found' THEN CASE WHEN length(address) >= 8 THEN 'pass:info' ELSE 'warning:warning' END WHEN 'unverified' THEN 'unverified:warning' ELSE absent END,
  CASE coalesce(genericName, 'notFound') WHEN 'found' THEN 'pass:info' WHEN 'unverified' THEN 'unverified:warning' ELSE absent END,
  CASE WHEN netQty = 'found' THEN 'pass:info' ELSE absent END,
  CASE coalesce(mfg, 'notFound') WHEN 'found' THEN 'pass:info' WHEN 'unverified' THEN 'unverified:warning' ELSE absent END,
  CASE coalesce(exp, 'notFound') WHEN 'found' THEN 'pass:info' WHEN 'unverified' THEN 'unverified:warning' ELSE 'warning:warning' END,
  CASE coalesce(mrp, 'notFound') WHEN 'found' THEN 'pass:info' WHEN 'unverified' THEN 'unverified:warning' ELSE absent END,
  CASE WHEN mrp = 'found' THEN CASE WHEN id % 3 = 0 THEN 'pass:info' ELSE 'warning:warning' END END,
  CASE WHEN mrp = 'found' AND id % 3 = 0 THEN 'manualReview:warning' END,
  CASE WHEN carePhone = 'found' AND careEmail = 'found' THEN 'pass:info' WHEN carePhone IN ('found', 'unverified') OR careEmail IN ('found', 'unverified') THEN
    CASE WHEN adequate AND coalesce(carePhone, '') <> 'found' AND coalesce(careEmail, '') <> 'found' THEN 'warning:warning' ELSE 'unverified:warning' END ELSE absent END,
  CASE WHEN id % 3 <> 0 OR role = 'importer' THEN CASE WHEN origin = 'found' THEN 'pass:info' ELSE absent END END,
  CASE coalesce(batch, 'notFound') WHEN 'found' THEN 'pass:info' WHEN 'unverified' THEN 'unverified:warning' ELSE 'warning:warning' END,
  CASE WHEN category = 'food' THEN CASE WHEN fssai = 'found' THEN 'pass:info' ELSE absent END END,
  CASE WHEN mean_confidence > 0 AND mean_confidence < 0.5::DOUBLE THEN 'unverified:warning' WHEN mean_confidence >= 0.5::DOUBLE AND mean_confidence < 0.65::DOUBLE THEN 'warning:warning' END,
  'manualReview:warning']) AS x, string_split(x, ':')[1] AS status, string_split(x, ':')[2] AS severity
 FROM (SELECT q.*, o.*, CASE WHEN adequate THEN 'fail:error' ELSE 'unverified:error' END AS absent FROM {QUALITY} q LEFT JOIN
  (SELECT scan_id, {_obs}, max('Plot ' || value) FILTER (WHERE field = 'manufacturer') AS address, max(CASE WHEN photo_index = 1 THEN 'importer' ELSE 'manufacturer' END) FILTER (WHERE field = 'manufacturer') AS role FROM {FIRST_OBS} GROUP BY scan_id) o ON q.id = o.scan_id)) WHERE x IS NOT NULL"""


@query(over("scan obs", f"SELECT id, seq::INTEGER AS rule_seq, code, status, severity FROM ({RULE_SQL})"))
def rules_from_observations(spark: SparkSession, d: str) -> DataFrame:
    return rules.exploded(rule_rows(spark, d), "id").select("id", "r.rule_seq", "r.code", "r.status", "r.severity")


# an observation's label, evidence, note and second reading by its photo
_about = "'read ' || value AS ev, CASE WHEN photo_index % 2 = 1 THEN 'Label' END AS label, CASE WHEN photo_index = 2 THEN 'smudged' END AS note, CASE WHEN photo_index = 3 THEN ' (dot-matrix re-read)' ELSE '' END AS again"
_q = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
_says = ", ".join(f"({', '.join(map(_q, (c, k, m, a, vocab.RESULT_FIELDS[c][1])))})" for c, k, m, a in vocab.FINDINGS)
FINDING_SQL = f""", r AS ({RULE_SQL}), o AS (SELECT *, {_about} FROM {FIRST_OBS}), says(code, kind, said, panel, subject) AS (VALUES {_says}),
 k AS (SELECT r.*, p.status = 'found' AS has_phone, e.status = 'found' AS has_email, p.value AS phone, e.value AS email, coalesce(p.ev, e.ev) AS care_ev, m.photo_index = 1 AS importer,
  CASE WHEN r.status = 'pass' THEN 'found' WHEN r.status = 'fail' THEN 'absent' WHEN r.status = 'warning' THEN 'warned' WHEN r.status = 'manualReview' THEN 'review' WHEN r.severity = 'error' THEN 'weak'
   WHEN r.code = 'LM-R6-CARE' AND (p.status = 'found' OR e.status = 'found') THEN 'partial' ELSE 'glimpsed' END AS kind
  FROM r LEFT JOIN o p ON p.scan_id = r.id AND p.field = 'carePhone' LEFT JOIN o e ON e.scan_id = r.id AND e.field = 'careEmail' LEFT JOIN o m ON m.scan_id = r.id AND m.field = 'manufacturer'),
 j AS (SELECT k.*, said, panel, o.value, o.ev, o.label, o.note, o.again, o.photo_index, scan.mean_confidence AS mc, (k.id % 7)::DOUBLE / 2 AS price,
  o.status IN ('found', 'unverified') AND k.kind IN ('found', 'glimpsed', 'warned', 'partial') AS shown
  FROM k JOIN says USING (code, kind) JOIN scan ON scan.id = k.id LEFT JOIN o ON o.scan_id = k.id AND o.field = says.subject)
 SELECT id, seq::INTEGER AS rule_seq, code, CASE WHEN kind = 'weak' THEN 'Could not verify — ' || said || ' not detected and the capture is too weak to prove absence' || CASE WHEN code = 'LM-R6-DATE-MFG' THEN '.' ELSE ' (see capture quality below).' END
  WHEN kind = 'glimpsed' AND note IS NOT NULL AND code IN ('LM-R6-MRP', 'LM-R6-BATCH', 'LM-R6-DATE-MFG', 'LM-R6-DATE-EXP') THEN note
  ELSE replace(said, '{{}}', CASE code WHEN 'LM-R6-NAME' THEN CASE WHEN importer THEN 'Importer' ELSE 'Manufacturer' END WHEN 'LM-R6-COMMON' THEN coalesce(value, '')
   WHEN 'LM-R6-MRP' THEN CASE WHEN price % 1 = 0 THEN price::BIGINT::VARCHAR ELSE printf('%.2f', price) END || ' detected' || coalesce(again, '') WHEN 'LM-R9-SINGLE-MRP' THEN '2'
   WHEN 'LM-R6-CARE' THEN CASE WHEN has_phone THEN 'phone' ELSE 'email' END WHEN 'LM-READ-QUALITY' THEN printf('%.0f', mc * 100) ELSE coalesce(again, '') END) END AS message,
  CASE WHEN code = 'LM-R9-SINGLE-MRP' THEN 'Mentions: 2' WHEN code = 'LM-READ-QUALITY' AND kind = 'glimpsed' THEN 'meanConfidence=' || printf('%.2f', mc) WHEN code = 'LM-R6-CARE' AND kind = 'found' THEN phone || ' • ' || email
   WHEN code = 'LM-R6-CARE' AND kind IN ('partial', 'glimpsed', 'warned') THEN care_ev
   WHEN shown AND kind = 'found' AND code IN ('LM-R6-NETQ', 'LM-R6-MRP', 'LM-R6-BATCH', 'LM-R6-DATE-MFG', 'LM-R6-DATE-EXP') THEN coalesce(label || ': ', '') || coalesce(ev, '') WHEN shown THEN ev END AS evidence,
  CASE WHEN shown THEN photo_index END AS photo_index, 'Capture a closer, flat, glare-free photo of the ' || panel || ' and re-scan.' AS action FROM j"""


@query(over("scan obs", "").rstrip() + FINDING_SQL)
def rule_findings(spark: SparkSession, d: str) -> DataFrame:
    """What each rule says of each scan: message, evidence, photo and action."""
    scans, best = rule_inputs(spark, d)
    photo = F.col("photo_index")
    priced = F.map_concat("data", F.create_map(F.lit("value"), (F.col("scan_id") % 7 / 2).cast("string")))
    best = best.withColumns({"data": priced, "evidence": F.concat(F.lit("read "), F.col("value")), "label": F.when(photo % 2 == 1, "Label"), "note": F.when(photo == 2, "smudged"), "relationship": F.when(photo == 3, "variable_crop")})
    return findings.findings(scans, best).select("id", "rule_seq", "code", "message", "evidence", "photo_index", "action")


@query(over("scan obs", f"SELECT id, greatest(0, 100 - sum(CASE status WHEN 'fail' THEN CASE WHEN severity = 'error' THEN 15 ELSE 10 END WHEN 'warning' THEN 5 WHEN 'unverified' THEN 5 WHEN 'manualReview' THEN 3 ELSE 0 END))::BIGINT AS score, CASE WHEN bool_or(status = 'fail') THEN 'nonCompliant' WHEN bool_or(status <> 'pass') THEN 'needsReview' ELSE 'compliant' END AS verdict FROM ({RULE_SQL}) GROUP BY id"))
def rule_score(spark: SparkSession, d: str) -> DataFrame:
    return rule_rows(spark, d).select("id", rules.score(F.col("results")).alias("score"), rules.verdict(F.col("results")).alias("verdict"))


@query(over("rr", "SELECT scan_id, greatest(0, 100 - sum(CASE status WHEN 'fail' THEN CASE WHEN severity = 'error' THEN 15 ELSE 10 END WHEN 'warning' THEN 5 WHEN 'unverified' THEN 5 WHEN 'manualReview' THEN 3 ELSE 0 END))::BIGINT AS score, CASE WHEN bool_or(status = 'fail') THEN 'nonCompliant' WHEN bool_or(status <> 'pass') THEN 'needsReview' ELSE 'compliant' END AS verdict FROM rr GROUP BY scan_id"))
def rule_verdict(spark: SparkSession, d: str) -> DataFrame:
    return reporting.scores(A.rule_results(spark, d))


@query(over("scan obs", f"SELECT code, status, count(*) AS n FROM ({RULE_SQL}) GROUP BY ALL"))
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = rules.exploded(rule_rows(spark, d))
    return rows.groupBy(F.col("r.code").alias("code"), F.col("r.status").alias("status")).agg(F.count("*").alias("n"))


@query(over("obs", f"SELECT scan_id, field, status, confidence, photo_index, value FROM {FIRST_OBS}"))
def observation_merge(spark: SparkSession, d: str) -> DataFrame:
    return merge.merged(A.observations(spark, d)).select("scan_id", "field", "status", "confidence", "photo_index", "value")


@query(over("obs", "SELECT scan_id, field, status, confidence, run_no, 2 AS merged_from FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, field ORDER BY CASE status WHEN 'found' THEN 2 WHEN 'unverified' THEN 1 ELSE 0 END DESC, confidence DESC, run_no, value) AS rn FROM obs WHERE run_no < 2) WHERE rn = 1"))
def observation_ensemble(spark: SparkSession, d: str) -> DataFrame:
    o = A.observations(spark, d)
    return merge.ensemble(o.where("run_no = 0"), o.where("run_no = 1")).select("scan_id", "field", "status", "confidence", "run_no", "merged_from")


CORRECTIONS = "(SELECT DISTINCT o_orderkey AS scan_id, ['mrp', 'netQty', 'brand', 'manufacturerAddress'][o_orderkey % 4 + 1] AS field, CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN ' Rs. 99.50 ' ELSE '1,5 kgs' END AS text FROM orders)"


@query(
    over(
        "obs",
        f"""SELECT o.scan_id, o.field, CASE WHEN c.text IS NULL THEN o.status WHEN trim(c.text) = '' THEN 'notFound' ELSE 'found' END AS status,
 CASE WHEN c.text IS NULL THEN o.value WHEN trim(c.text) = '' THEN NULL ELSE trim(c.text) END AS value, CASE WHEN c.text IS NULL THEN o.confidence WHEN trim(c.text) = '' THEN 0 ELSE 0.95::DOUBLE END AS confidence,
 CASE WHEN c.text IS NULL OR trim(c.text) = '' THEN NULL WHEN o.field = 'mrp' THEN CASE o.scan_id % 3 WHEN 1 THEN 99.5::DOUBLE ELSE 15 END WHEN o.field = 'netQty' THEN CASE o.scan_id % 3 WHEN 1 THEN NULL ELSE 1.5::DOUBLE END END AS number,
 CASE WHEN c.text IS NOT NULL AND o.field = 'netQty' AND o.scan_id % 3 = 2 THEN 'kg' END AS unit, a.address
 FROM {FIRST_OBS} o LEFT JOIN {CORRECTIONS} c ON o.scan_id = c.scan_id AND o.field = c.field
 LEFT JOIN (SELECT scan_id, trim(text) AS address FROM {CORRECTIONS} WHERE field = 'manufacturerAddress' AND trim(text) <> '') a ON o.scan_id = a.scan_id AND o.field = 'manufacturer'""",
    )
)
def apply_corrections(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "  ").when(k % 3 == 1, " Rs. 99.50 ").otherwise("1,5 kgs")
    given = A.table(spark, d, "orders").select(k.alias("scan_id"), A.pick(["mrp", "netQty", "brand", "manufacturerAddress"], k % 4).alias("field"), text.alias("text")).distinct()
    return merge.corrected(merge.merged(A.observations(spark, d)), given).select("scan_id", "field", "status", "value", "confidence", "number", "unit", "address")


# --- stored report JSON

REPORT = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '{"v":2,"fields":{"mrp":{"status":"found","value":"Rs. ' || (o_orderkey % 90)::VARCHAR || '","fieldConfidence":0.9},"brand":{"status":"odd","value":"B"}}}'
 WHEN 1 THEN '{"mrpRaw":"Rs. 42","mrpValue":42,"genericName":"Potato Chips","batchRaw":" ","fieldConfidence":{"mrp":0.75}}' WHEN 2 THEN '{broken' END AS report FROM orders"""


def stored_reports(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    v2 = F.concat(F.lit('{"v":2,"fields":{"mrp":{"status":"found","value":"Rs. '), (k % 90).cast("string"), F.lit('","fieldConfidence":0.9},"brand":{"status":"odd","value":"B"}}}'))
    v1 = F.lit('{"mrpRaw":"Rs. 42","mrpValue":42,"genericName":"Potato Chips","batchRaw":" ","fieldConfidence":{"mrp":0.75}}')
    return A.table(spark, d, "orders").select(k.alias("id"), F.when(k % 4 == 0, v2).when(k % 4 == 1, v1).when(k % 4 == 2, "{broken").alias("report"))


@query(
    f"""WITH r AS ({REPORT}) SELECT id, 'mrp' AS field, 'found' AS status, 'Rs. ' || (id % 90)::VARCHAR AS value, 0.9::DOUBLE AS confidence FROM r WHERE id % 4 = 0 UNION ALL
 SELECT id, 'brand', 'notFound', 'B', 0 FROM r WHERE id % 4 = 0 UNION ALL SELECT id, 'mrp', 'found', 'Rs. 42', 0.75::DOUBLE FROM r WHERE id % 4 = 1 UNION ALL
 SELECT id, 'genericName', 'found', 'Potato Chips', 0.5::DOUBLE FROM r WHERE id % 4 = 1 UNION ALL SELECT id, 'batch', 'notFound', ' ', 0.5::DOUBLE FROM r WHERE id % 4 = 1"""
)
def report_v1_import(spark: SparkSession, d: str) -> DataFrame:
    return merge.decoded(stored_reports(spark, d), "id", "report").select("id", "field", "status", "value", "confidence")


@query(f"WITH r AS ({REPORT}) SELECT id, report IS NOT NULL AND id % 4 <> 2 AS readable FROM r")
def report_json_bad_input(spark: SparkSession, d: str) -> DataFrame:
    return stored_reports(spark, d).select("id", F.expr("try_parse_json(report) is not null").alias("readable"))


@query(over("obs", f"SELECT scan_id, count(*) AS n, max(value) FILTER (WHERE field = 'mrp') AS mrp FROM {FIRST_OBS} GROUP BY scan_id"))
def report_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    written = merge.encoded(merge.merged(A.observations(spark, d)))
    back = merge.decoded(written, "scan_id", "report")
    return back.groupBy("scan_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("field") == "mrp", F.col("value"))).alias("mrp"))


# --- outbox

@query(over("outbox", "SELECT id, created_at, officer_id, kind FROM outbox WHERE NOT synced ORDER BY created_at, id LIMIT 50"))
def outbox_pending(spark: SparkSession, d: str) -> DataFrame:
    return A.outbox(spark, d).where("not synced").orderBy("created_at", "id").select("id", "created_at", "officer_id", "kind").limit(50)


@query(over("outbox", "SELECT count(*) FILTER (WHERE NOT synced) AS unsynced, count(*) AS total FROM outbox"))
def outbox_unsynced_count(spark: SparkSession, d: str) -> DataFrame:
    return A.outbox(spark, d).agg(F.count_if(~F.col("synced")).alias("unsynced"), F.count("*").alias("total"))


@query(over("scan", "SELECT id, verdict, score FROM (SELECT *, row_number() OVER (PARTITION BY officer_id ORDER BY created_at DESC, id) AS rn FROM scan) WHERE rn = 1"))
def latest_scan_by_officer(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("officer_id").orderBy(F.desc("created_at"), "id")
    return A.scans(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "verdict", "score")
