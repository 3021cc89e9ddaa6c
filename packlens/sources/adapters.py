"""The engine's logical tables over the star-schema test tables, for queries and benchmarks.

Each has a twin in ADAPTER_SQL, which any SQL engine can run over the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.functions import vocab


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over the session's tasks, for rows of which much is made: a small file is one task, whatever comes of it.

    What is gathered by the key, or by it and more, needs no further shuffle.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Product "), (F.col("o_orderkey") % 997).cast("string")).alias("product_name"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "food").otherwise("general").alias("category"),
        F.when(status == "F", "compliant").when(status == "O", "nonCompliant").otherwise("needsReview").alias("verdict"),
        (F.floor("o_totalprice").cast("long") % 101).alias("score"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_custkey").alias("officer_id"),
        (F.col("o_orderkey") % 4 + 1).alias("photo_count"),
        (F.floor("o_totalprice").cast("long") % 100 / 100).alias("mean_confidence"),
        (F.col("o_orderkey") % 40).alias("region_count"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("user_name"),
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]+", ".")), F.lit("@office.example")).alias("email"),
        F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "viewer").otherwise("officer").alias("role"),
        F.concat(F.lit("hash-"), F.col("c_custkey").cast("string")).alias("password_hash"),
    )


def rule_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    status = (
        F.when((flag == "A") & (line == "F"), "pass").when((flag == "A") & (line == "O"), "warning").when((flag == "N") & (line == "F"), "fail")
        .when((flag == "N") & (line == "O"), "manualReview").when((flag == "R") & (line == "F"), "unverified").otherwise("pass")
    )
    code = F.col("l_partkey") % len(vocab.CODES)
    return li.select(F.col("l_orderkey").alias("scan_id"), code.alias("rule_seq"), pick(vocab.CODES, code).alias("code"), status.alias("status"), F.when(F.col("l_suppkey") % 2 == 0, "error").otherwise("warning").alias("severity"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_orderkey").alias("scan_id"),
        F.col("l_linenumber").cast("int").alias("photo_index"),
        pick(vocab.FIELDS, F.col("l_partkey") % len(vocab.FIELDS)).alias("field"),
        F.when(flag == "A", "found").when(flag == "N", "unverified").otherwise("notFound").alias("status"),
        F.concat(F.lit("v"), F.col("l_suppkey").cast("string")).alias("value"),
        (F.col("l_quantity") / 50).alias("confidence"),
        (F.col("l_suppkey") % 3).cast("int").alias("run_no"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p, s = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier"))
    # part and supplier are dimensions; Spark broadcasts them by their own sizes
    df = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    key = F.col("l_partkey")
    return df.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").cast("int").alias("line_no"),
        F.when(key % 11 != 0, F.col("p_name")).otherwise("").alias("productName"),
        F.when(key % 5 == 0, "food").when(key % 7 == 0, "Cosmetic").otherwise("General").alias("category"),
        F.when(key % 13 == 0, F.lit("n/a")).when(key % 17 == 0, F.lit("0")).otherwise(F.col("p_retailprice").cast("string")).alias("mrp_raw"),
        F.when(key % 13 == 0, F.lit(None).cast("double")).when(key % 17 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice")).alias("mrp"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("sellingPrice"),
        F.col("o_orderdate").alias("manufacturingDate"),
        F.when(key % 19 != 0, F.col("l_shipdate")).alias("expiryDate"),
        F.when(key % 23 != 0, F.struct(F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Street "), F.col("s_nationkey").cast("string"))).alias("address"))).alias("manufacturer"),
        F.concat(F.lit("B"), key.cast("string")).alias("batchNumber"),
    )


def regulations(spark: SparkSession) -> DataFrame:
    rows = []
    for category in vocab.CATEGORIES:
        rules = [{"code": c, "name": n, "clause": k, "severity": s} for c, n, k, s in vocab.RULES if category == "food" or c != "LM-FOOD-FSSAI"]
        rows.append((category, vocab.CATALOG_VERSION, vocab.EFFECTIVE_FROM, vocab.REQUIRED_FIELDS[category], rules))
    rule = "struct<code:string,name:string,clause:string,severity:string>"
    return spark.createDataFrame(rows, f"category string, version string, effectiveFrom string, requiredFields array<string>, rules array<{rule}>")


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").alias("officer_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 3 != 0).alias("synced"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of each part, some garbled or wrapped: scan_id, photo, line_no, block_no, text, conf, cy, top."""
    p = spread(table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    pad = lambda c, n: F.lpad(s(c), n, "0")
    cents = F.floor(F.col("p_retailprice") * 100 + 0.5).cast("long")
    price = F.concat(s(F.floor(cents / 100)), F.lit("."), pad(cents % 100, 2))
    date = lambda a, y: F.concat(pad(k % 28 + 1, 2), F.lit(a), pad(k % 12 + 1, 2), F.lit(a), s(k % 5 + y))
    wrapped, glued = k % 5 == 0, k % 7 == 0
    texts = [
        (0, F.col("p_name")),
        (1, F.when(glued, F.lit("NET")).otherwise(F.concat(F.lit("NET QTY: "), s(F.col("p_size")), F.lit(" g")))),
        (1, F.when(glued, F.concat(F.lit("WEIGHT: "), s(F.col("p_size")), F.lit(" ml"))).otherwise(F.lit("Per 100 g serving 12 g"))),
        (2, F.when(wrapped, F.lit("M.R.P.")).otherwise(F.concat(F.lit("MRP Rs. "), price, F.lit(" (0.16/g) inclusive of all taxes")))),
        (2, F.when(wrapped, F.concat(F.lit("Rs. "), price)).otherwise(F.lit("see bottom"))),
        (2, F.when(k % 3 == 0, F.concat(F.lit("Batch No. "), F.lit("PP"), s(k), F.lit("E"))).when(k % 3 == 1, F.lit("Batch Number")).otherwise(F.concat(F.lit("Lot No: L-"), s(k)))),
        (2, F.concat(F.lit("Date of Mfg.: "), date("/", 2019))),
        (2, F.when(k % 4 == 0, F.concat(F.lit("Best Before "), F.lit("March "), s(k % 5 + 2022))).otherwise(F.concat(F.lit("Use by: "), date(".", 2022)))),
        (3, F.concat(F.lit("Manufactured by: "), F.col("p_brand"), F.lit(" Foods Ltd"))),
        (3, F.concat(F.lit("Plot "), s(k % 90 + 1), F.lit(", Pune "), s(k % 800000 + 110001))),
        (4, F.concat(F.lit("Customer Care: 1800 "), pad(k % 1000, 3), F.lit(" "), pad(k % 10000, 4))),
        (4, F.concat(F.lit("care"), s(k), F.lit("@"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), F.lit(".example"))),
        (5, F.concat(F.lit("FSSAI Lic. No. "), pad(k + 10012000000000, 14))),
        (5, F.when(k % 6 == 0, F.lit("Country of origin: sri lanka, imported")).otherwise(F.lit("Made in India"))),
        (6, F.concat(F.lit("8901"), pad(k, 9))),
    ]
    rows = F.posexplode(F.array(*[F.struct(F.lit(b).alias("block_no"), t.alias("text")) for b, t in texts])).alias("line_no", "line")
    df = p.select(k.alias("scan_id"), rows)
    return df.select(
        "scan_id",
        F.lit(0).alias("photo"),
        F.col("line_no").cast("int").alias("line_no"),
        "line.block_no",
        "line.text",
        ((F.col("scan_id") + F.col("line_no")) % 40 / 100 + F.lit(0.6)).alias("conf"),
        (F.col("line_no") * F.lit(0.04) + F.lit(0.1)).alias("cy"),
        (F.col("line_no") * F.lit(0.04) + F.lit(0.09)).alias("top"),
    )


_codes = ", ".join(f"'{c}'" for c in vocab.CODES)
_fields = ", ".join(f"'{c}'" for c in vocab.FIELDS)
_DATE = "lpad((k % 28 + 1)::VARCHAR, 2, '0') || '{0}' || lpad((k % 12 + 1)::VARCHAR, 2, '0') || '{0}' || (k % 5 + {1})::VARCHAR"
ADAPTER_SQL = {
    "scan": """SELECT o_orderkey AS id, 'Product ' || (o_orderkey % 997)::VARCHAR AS product_name,
 CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'food' ELSE 'general' END AS category,
 CASE o_orderstatus WHEN 'F' THEN 'compliant' WHEN 'O' THEN 'nonCompliant' ELSE 'needsReview' END AS verdict,
 floor(o_totalprice)::BIGINT % 101 AS score, o_orderdate AS created_at, o_custkey AS officer_id, o_orderkey % 4 + 1 AS photo_count,
 (floor(o_totalprice)::BIGINT % 100)::DOUBLE / 100 AS mean_confidence, o_orderkey % 40 AS region_count FROM orders""",
    "usr": """SELECT c_custkey AS user_id, c_name AS user_name, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '.', 'g')) || '@office.example' AS email,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'viewer' ELSE 'officer' END AS role FROM customer""",
    "rr": f"""SELECT l_orderkey AS scan_id, l_partkey % 14 AS rule_seq, ([{_codes}])[l_partkey % 14 + 1] AS code,
 CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'pass' WHEN 'AO' THEN 'warning' WHEN 'NF' THEN 'fail' WHEN 'NO' THEN 'manualReview' WHEN 'RF' THEN 'unverified' ELSE 'pass' END AS status,
 CASE WHEN l_suppkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM lineitem""",
    "obs": f"""SELECT l_orderkey AS scan_id, l_linenumber AS photo_index, ([{_fields}])[l_partkey % 16 + 1] AS field,
 CASE l_returnflag WHEN 'A' THEN 'found' WHEN 'N' THEN 'unverified' ELSE 'notFound' END AS status, 'v' || l_suppkey::VARCHAR AS value,
 l_quantity / 50 AS confidence, (l_suppkey % 3)::INTEGER AS run_no FROM lineitem""",
    "product": """SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE WHEN l_partkey % 11 <> 0 THEN p_name ELSE '' END AS productName,
 CASE WHEN l_partkey % 5 = 0 THEN 'food' WHEN l_partkey % 7 = 0 THEN 'Cosmetic' ELSE 'General' END AS category, l_partkey % 13 = 0 AS mrp_text,
 CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS mrp,
 l_extendedprice / l_quantity AS sellingPrice, o_orderdate AS manufacturingDate, CASE WHEN l_partkey % 19 <> 0 THEN l_shipdate END AS expiryDate,
 l_partkey % 23 <> 0 AS has_manufacturer, s_name AS m_name, CASE WHEN s_acctbal > 0 THEN 'Street ' || s_nationkey::VARCHAR END AS m_address
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "regulation": "SELECT * FROM (VALUES "
    + ", ".join(f"('{c}', '{vocab.CATALOG_VERSION}', [{', '.join(repr(f) for f in vocab.REQUIRED_FIELDS[c])}], {len(vocab.CODES) - (c != 'food')})" for c in vocab.CATEGORIES)
    + ") AS t(category, version, requiredFields, n_rules)",
    "outbox": "SELECT event_id AS id, ts AS created_at, user_id AS officer_id, event_type AS kind, event_id % 3 <> 0 AS synced FROM events",
    "line": f"""SELECT k AS scan_id, 0 AS photo, line_no::INTEGER AS line_no, ([0,1,1,2,2,2,2,2,3,3,4,4,5,5,6])[line_no + 1] AS block_no, ts[line_no + 1] AS text,
 ((k + line_no) % 40)::DOUBLE / 100 + 0.6::DOUBLE AS conf, line_no * 0.04::DOUBLE + 0.1::DOUBLE AS cy, line_no * 0.04::DOUBLE + 0.09::DOUBLE AS top
 FROM (SELECT k, unnest(range(15)) AS line_no, [p_name,
  CASE WHEN k % 7 = 0 THEN 'NET' ELSE 'NET QTY: ' || p_size::VARCHAR || ' g' END,
  CASE WHEN k % 7 = 0 THEN 'WEIGHT: ' || p_size::VARCHAR || ' ml' ELSE 'Per 100 g serving 12 g' END,
  CASE WHEN k % 5 = 0 THEN 'M.R.P.' ELSE 'MRP Rs. ' || price || ' (0.16/g) inclusive of all taxes' END,
  CASE WHEN k % 5 = 0 THEN 'Rs. ' || price ELSE 'see bottom' END,
  CASE k % 3 WHEN 0 THEN 'Batch No. PP' || k::VARCHAR || 'E' WHEN 1 THEN 'Batch Number' ELSE 'Lot No: L-' || k::VARCHAR END,
  'Date of Mfg.: ' || {_DATE.format("/", 2019)},
  CASE WHEN k % 4 = 0 THEN 'Best Before March ' || (k % 5 + 2022)::VARCHAR ELSE 'Use by: ' || {_DATE.format(".", 2022)} END,
  'Manufactured by: ' || p_brand || ' Foods Ltd', 'Plot ' || (k % 90 + 1)::VARCHAR || ', Pune ' || (k % 800000 + 110001)::VARCHAR,
  'Customer Care: 1800 ' || lpad((k % 1000)::VARCHAR, 3, '0') || ' ' || lpad((k % 10000)::VARCHAR, 4, '0'),
  'care' || k::VARCHAR || '@' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) || '.example',
  'FSSAI Lic. No. ' || lpad((k + 10012000000000)::VARCHAR, 14, '0'),
  CASE WHEN k % 6 = 0 THEN 'Country of origin: sri lanka, imported' ELSE 'Made in India' END, '8901' || lpad(k::VARCHAR, 9, '0')] AS ts
  FROM (SELECT *, p_partkey AS k, (c // 100)::VARCHAR || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS price FROM (SELECT *, floor(p_retailprice * 100 + 0.5::DOUBLE)::BIGINT AS c FROM part)))""",
}


def over(names: str, query: str) -> str:
    """A query with the adapters that it names as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({ADAPTER_SQL[n]})" for n in names.split()) + " " + query
