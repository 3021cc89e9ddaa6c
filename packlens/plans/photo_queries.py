"""Queries of photos, stored tables and a stream's progress, over data that Spark derives from the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.operators import constraints, layout, recognise
from packlens.sources import adapters as A
from packlens.sources import photos as P
from packlens.sources import scratch
from packlens.sources.adapters import over
from packlens.sources.stored import StoredTable
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


# --- photos: headers of several formats with a label's lines behind them, two of each part

MARK = b"\n#LABEL\n"


def photos(spark: SparkSession, d: str) -> DataFrame:
    """scan_id, photo, kind, content: PNG, two JPEGs, GIF, BMP, two WebPs, and files that are broken or gone."""
    text = A.label_lines(spark, d).groupBy("scan_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    df = text.select("scan_id", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("photo"))
    k = F.col("scan_id")
    df = df.withColumns({"kind": F.when(F.col("photo") == 0, k % 8).otherwise(F.floor(k / 8) % 8), "w": 200 + (k * 37 + F.col("photo")) % 4000, "h": 100 + (k * 53) % 3500})
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    turned = lambda x, n: F.concat(*[F.substring(x, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    little = lambda c, n: turned(big(c, n), n)
    w, h = F.col("w"), F.col("h")
    frame = lambda c: F.concat(F.lit(f"FF{c}001108"), big(h, 2), big(w, 2), F.lit("03012200021101031101"))
    exif = "FFE10022457869660000" + "4D4D002A00000008" + "0001" + "011200030000000100060000" + "00000000"
    riff = lambda c: f"524946460000000057454250565038{c}00000000"
    heads = [
        F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4), F.lit("0806000000")),
        F.concat(F.lit("FFD8FFE000104A46494600010100000100010000"), frame("C0")),
        F.concat(F.lit("FFD8" + exif + "FFFE00046869" * 40), frame("C2")),
        F.concat(F.lit("474946383961"), little(w, 2), little(h, 2), F.lit("000000")),
        F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(F.lit(1 << 32) - h, 4)),
        F.concat(F.lit(riff("58") + "00000000"), little(w - 1, 3), little(h - 1, 3)),
        F.concat(F.lit(riff("4C") + "2F"), little((w - 1) + (h - 1) * 16384, 4)),
    ]
    hexed = F.when(F.col("kind") < 7, F.element_at(F.array(*heads), (F.least(F.col("kind"), F.lit(6)) + 1).cast("int"))).when(k % 2 == 0, "68656C6C6F")
    return df.select("scan_id", "photo", "kind", F.unhex(F.concat(hexed, F.when(F.col("kind") < 7, F.concat(F.lit(MARK.hex()), F.hex("text"))).otherwise(""))).alias("content"))


def of_label(content: bytes, side: int) -> Iterator[recognise.Region]:
    """A recogniser of these photos: reads each word of the label behind the header."""
    for i, line in enumerate(content.partition(MARK)[2].decode().split("\n")):
        x = 10.0
        for word in line.split():
            end = x + 10.0 * len(word)
            yield word, 0.9, [(x, 40.0 * i), (end, 40.0 * i), (end, 40.0 * i + 20), (x, 40.0 * i + 20)]
            x = end + 10


PHOTO = """SELECT *, CASE WHEN kind < 7 THEN 200 + (k * 37 + photo) % 4000 ELSE 0 END AS w, CASE WHEN kind < 7 THEN 100 + k * 53 % 3500 ELSE 0 END AS h FROM
 (SELECT p_partkey AS k, photo, CASE photo WHEN 0 THEN p_partkey % 8 ELSE p_partkey // 8 % 8 END AS kind FROM part, (VALUES (0), (1)) x(photo))"""


@query(f"SELECT k AS scan_id, photo, CASE WHEN kind < 7 THEN ['png', 'jpeg', 'jpeg', 'gif', 'bmp', 'webp', 'webp'][kind + 1] END AS format, w::INTEGER AS width, h::INTEGER AS height, CASE WHEN kind = 2 THEN 6 ELSE 1 END AS orientation FROM ({PHOTO})")
def photo_bounds(spark: SparkSession, d: str) -> DataFrame:
    return P.with_bounds(photos(spark, d)).select("scan_id", "photo", "format", "width", "height", "orientation")


@query(f"""SELECT k AS scan_id, photo, round(uw * scale)::INTEGER AS prepared_width, round(uh * scale)::INTEGER AS prepared_height FROM (SELECT *,
 CASE WHEN side = 0 THEN 1 WHEN side > 3200 THEN 3200.0::DOUBLE / side WHEN side < 2400 AND larger > 1.05::DOUBLE THEN larger ELSE 1 END AS scale FROM (SELECT *, greatest(uw, uh) AS side,
 CASE WHEN uw > 0 THEN least(2.0::DOUBLE, 3200.0::DOUBLE / greatest(uw, uh), sqrt(12000000.0::DOUBLE / (uw * uh))) END AS larger FROM (SELECT *, CASE WHEN kind = 2 THEN h ELSE w END AS uw, CASE WHEN kind = 2 THEN w ELSE h END AS uh FROM ({PHOTO}))))""")
def photo_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The sizes that preparing aims at."""
    return P.with_prepared_size(P.with_bounds(photos(spark, d))).select("scan_id", "photo", "prepared_width", "prepared_height")


@query(over("line", f"SELECT k AS scan_id, p.photo, line_no AS line_no, text FROM ({PHOTO}) p JOIN line ON scan_id = k WHERE kind < 7"))
def photo_lines(spark: SparkSession, d: str) -> DataFrame:
    """From photos to lines of text by a recogniser run over them."""
    tokens, _ = recognise.scanned(photos(spark, d), of_label)
    return layout.lines(tokens).select("scan_id", "photo", "line_no", "text")


@query(over("line", f"""SELECT k AS scan_id, count(*) AS n_photos, count(*) FILTER (WHERE kind < 7) AS n_readable, count(*) FILTER (WHERE kind = 7 AND k % 2 = 1) AS n_failed,
 count(*) FILTER (WHERE kind < 7) * 0.9::DOUBLE / count(*) AS mean_confidence, (count(*) FILTER (WHERE kind < 7) * max(n))::BIGINT AS region_count,
 CASE WHEN count(*) FILTER (WHERE kind < 7) = 0 THEN 'No readable photos — all 2 image(s) failed to load or decode.' END AS error
 FROM ({PHOTO}) JOIN (SELECT scan_id, sum(len(string_split(text, ' '))) AS n FROM line GROUP BY scan_id) ON scan_id = k GROUP BY k"""))
def photo_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What a scan's photos gave; broken and missing ones are counted, a scan of nothing else has an error."""
    return recognise.scanned(photos(spark, d), of_label)[1]


# --- stored tables


@query(over("outbox", """SELECT CASE WHEN c = 1 THEN -id ELSE id END AS id, created_at, officer_id, CASE WHEN c = 1 THEN 'copy' WHEN id % 10 = 7 THEN 'late' ELSE kind END AS kind, CASE WHEN c = 1 THEN false WHEN id % 10 = 7 THEN NULL WHEN id % 4 = 1 THEN true ELSE synced END AS synced
 FROM outbox, (VALUES (0), (1)) x(c) WHERE CASE WHEN c = 1 THEN id % 50 = 0 AND id <> 0 ELSE id % 10 <> 7 OR id % 4 = 1 END"""))
def stored_outbox(spark: SparkSession, d: str) -> DataFrame:
    """The outbox as a stored table, after inserts, an update, a delete, upserts, and a failed insert that left no trace."""
    box, k = A.outbox(spark, d), F.col("id")
    t = StoredTable(spark, f"{scratch.shared_dir(spark)}/packlens/stored-{uuid.uuid4().hex}", box.schema, "id", rules=[constraints.Rule("kind", required=True)], buckets=8)
    t.reseed(box)
    t.update(box.where(k % 4 == 1).select("id", F.lit(True).alias("synced")))
    t.delete(box.where(k % 10 == 7))
    t.insert(box.where((k % 50 == 0) & (k != 0)).withColumns({"id": -k, "kind": F.lit("copy"), "synced": F.lit(False)}))
    t.upsert(box.where((k % 10 == 7) & (k % 4 == 1)).select("id", "created_at", "officer_id", F.lit("late").alias("kind")))
    return t.read()


def catalog(spark: SparkSession) -> DataFrame:
    """The catalog as seeded into a stored table and read again."""
    rows = A.regulations(spark)
    t = StoredTable(spark, f"{scratch.shared_dir(spark)}/packlens/catalog-{uuid.uuid4().hex}", rows.schema, "category", rules=[constraints.Rule("category", required=True, trim=True, lower=True)], buckets=4)
    t.reseed(rows)
    return t.read()


@query(over("product regulation", "SELECT category, any_value(version) AS version, any_value(n_rules)::INTEGER AS n_rules, any_value(len(requiredFields))::INTEGER AS n_required, count(p) AS n_products FROM regulation LEFT JOIN (SELECT lower(category) AS category, 1 AS p FROM product) USING (category) GROUP BY category"))
def regulations_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The stored catalog, with how many products each category has to do with."""
    n = A.products(spark, d).groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("n_products"))
    df = catalog(spark).join(n, "category", "left")
    return df.select("category", "version", F.size("rules").alias("n_rules"), F.size("requiredFields").alias("n_required"), F.coalesce("n_products", F.lit(0)).alias("n_products"))


@query(over("product regulation", "SELECT category, seq, field, count(p) AS n_products FROM (SELECT category, unnest(range(len(requiredFields)))::INTEGER AS seq, unnest(requiredFields) AS field FROM regulation WHERE category = lower('FOOD')) LEFT JOIN (SELECT lower(category) AS category, 1 AS p FROM product) USING (category) GROUP BY ALL"))
def required_fields_exploded(spark: SparkSession, d: str) -> DataFrame:
    """Required fields of one category of the stored catalog, in order, and the products that must have them."""
    n = A.products(spark, d).groupBy(F.lower("category").alias("category")).agg(F.count("*").alias("n_products"))
    df = catalog(spark).where(F.col("category") == "FOOD".lower()).select("category", F.posexplode("requiredFields").alias("seq", "field")).join(n, "category", "left")
    return df.withColumn("n_products", F.coalesce("n_products", F.lit(0)))


# --- rules of tables


def _dirty_users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("user_id")
    some = lambda n, c, other: F.when(k % n == 0, other).otherwise(c)
    return A.users(spark, d).select(
        "user_id", some(7, F.concat(F.lit("  "), F.col("user_name"), F.lit("\t")), F.lit("   ")).alias("name"), some(11, F.upper("email"), F.lit(None)).alias("email"),
        F.col("password_hash").alias("passwordHash"), F.when(k % 3 == 0, None).otherwise(F.col("role")).alias("role"),
    )


USERS = """SELECT user_id, CASE WHEN user_id % 7 = 0 THEN '' ELSE user_name END AS name, CASE WHEN user_id % 11 <> 0 THEN email END AS email, CASE WHEN user_id % 3 = 0 THEN 'officer' ELSE role END AS role,
 user_id % 7 = 0 AS a, user_id % 11 = 0 AS b, user_id % 3 <> 0 AND role = 'viewer' AS c FROM usr"""


@query(over("usr", f"SELECT user_id, name, lower(email) AS email, role FROM ({USERS}) WHERE NOT (a OR b OR c)"))
def users_in_shape(spark: SparkSession, d: str) -> DataFrame:
    return constraints.constrained(_dirty_users(spark, d), constraints.USER)[0].select("user_id", "name", "email", "role")


@query(over("usr", f"SELECT user_id, CASE i WHEN 0 THEN 'name' WHEN 1 THEN 'email' ELSE 'role' END AS \"column\", CASE i WHEN 2 THEN 'enum' ELSE 'required' END AS broken FROM ({USERS}), (VALUES (0), (1), (2)) x(i) WHERE CASE i WHEN 0 THEN a WHEN 1 THEN b ELSE c END"))
def users_in_quarantine(spark: SparkSession, d: str) -> DataFrame:
    bad = constraints.constrained(_dirty_users(spark, d), constraints.USER)[1]
    return bad.select("user_id", F.explode("broken").alias("b")).select("user_id", "b.column", "b.broken")


@query(over("product", """SELECT "column", broken, count(*) AS "count" FROM (SELECT unnest([CASE WHEN productName = '' OR productName IS NULL THEN 'productName required' END, 'brand required', CASE WHEN NOT has_manufacturer OR m_name IS NULL THEN 'manufacturer.name required' END,
 CASE WHEN NOT has_manufacturer OR m_address IS NULL THEN 'manufacturer.address required' END, 'netQuantity required', CASE WHEN mrp IS NULL THEN 'mrp required' END, CASE WHEN expiryDate IS NULL THEN 'expiryDate required' END]) AS x FROM product),
 LATERAL (SELECT string_split(x, ' ')[1] AS "column", string_split(x, ' ')[2] AS broken) WHERE x IS NOT NULL GROUP BY ALL"""))
def product_constraints(spark: SparkSession, d: str) -> DataFrame:
    """What products break of their schema, and how often; the test tables give no brand and no net quantity."""
    # a filter by the number of reasons would have them computed twice; rows without any give nothing here
    return constraints.reasons(constraints.evaluated(A.products(spark, d), constraints.PRODUCT))


# --- progress


@query("SELECT 'drain' AS name, count(*) AS n_rows, count(*) FILTER (WHERE event_id % 3 = 0) AS n_kept FROM events")
def drain_progress(spark: SparkSession, d: str) -> DataFrame:
    """What a listener's table says of a drained outbox: rows read in all batches, and ids kept in state at the end."""
    at = f"{scratch.shared_dir(spark)}/packlens/progress-{uuid.uuid4().hex}"
    log = stream.Progress()
    spark.streams.addListener(log)
    try:
        folder, glob = (d, "events.parquet") if scratch.is_file(spark, f"{d}/events.parquet") else (f"{d}/events.parquet", "*.parquet")
        raw = stream.landed(spark, folder, A.table(spark, d, "events").schema, glob)
        events = raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 3 != 0).alias("synced"))
        q = stream.drained(events, f"{at}/table", f"{at}/checkpoint", "drain")
        q.awaitTermination()
        log.settled(q)
    finally:
        spark.streams.removeListener(log)
    log.write(spark, f"{at}/progress")
    batch = spark.read.schema(log.SCHEMA).parquet(f"{at}/progress").where("stage = 'addBatch' and name = 'drain'")
    return batch.groupBy("name").agg(F.sum("n_rows").alias("n_rows"), F.max("state_rows").alias("n_kept"))
