"""Validation of structured products against their category's regulation, and ingest of scans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import vocab

ERROR = "struct<seq:int,rule_code:string,field:string>"


def with_regulation(products: DataFrame, regulations: DataFrame) -> DataFrame:
    """Products joined to the regulation of their lower-cased category; others are left out."""
    own = regulations.select(F.col("category").alias("__category"), "version", "requiredFields")
    return products.join(own, F.lower("category") == F.col("__category")).drop("__category")


def without_regulation(products: DataFrame, regulations: DataFrame) -> DataFrame:
    return products.join(regulations.select(F.col("category").alias("__category")), F.lower("category") == F.col("__category"), "left_anti")


def blank(df: DataFrame, field: str) -> Column:
    """Whether a required field, by dotted path, is missing, null or ''."""
    head = field.split(".")[0]
    if head not in df.columns:
        return F.lit(True)
    c = F.col(field)
    kind = dict(df.dtypes)[head]
    return c.isNull() | (c.cast("string") == "") if kind == "string" else c.isNull()


def validated(products: DataFrame, regulations: DataFrame, now: datetime) -> DataFrame:
    """Products of known categories with errors (in order of the rules), status and score.

    A price given as text (mrp_raw without mrp) is of the wrong type. Comparisons with nulls do not fail.
    """
    df = with_regulation(products, regulations)
    fields = sorted({f for fs in vocab.REQUIRED_FIELDS.values() for f in fs})
    missing = F.create_map(*[x for f in fields for x in (F.lit(f), blank(df, "mrp_raw" if f == "mrp" and "mrp_raw" in df.columns else f))])
    required = F.transform(F.filter("requiredFields", lambda f: F.coalesce(F.try_element_at(missing, f), F.lit(True))), lambda f: F.struct(F.lit(0).alias("seq"), F.lit("REQUIRED_FIELD").alias("rule_code"), f.alias("field")))
    mrp, selling, made, expiry, maker = (F.col(c) for c in ("mrp", "sellingPrice", "manufacturingDate", "expiryDate", "manufacturer"))
    blank_text = lambda c: c.isNull() | (c == "")
    rules = [
        ("PRICE_TYPE", "mrp", F.col("mrp_raw").isNotNull() & mrp.isNull()),
        ("PRICE_002", "mrp", mrp <= 0),
        ("PRICE_001", "sellingPrice", selling > mrp),
        ("DATE_001", "expiryDate", expiry <= made),
        ("DATE_002", "expiryDate", expiry < F.lit(now)),
        ("MANUFACTURER_001", "manufacturer.name", maker.isNotNull() & blank_text(maker["name"])),
        ("MANUFACTURER_002", "manufacturer.address", maker.isNotNull() & blank_text(maker["address"])),
    ]
    found = [F.when(when, F.struct(F.lit(i).alias("seq"), F.lit(code).alias("rule_code"), F.lit(field).alias("field"))) for i, (code, field, when) in enumerate(rules, 1)]
    errors = F.concat(required.cast(f"array<{ERROR}>"), F.array_compact(F.array(*found)).cast(f"array<{ERROR}>"))
    df = df.withColumn("errors", errors)
    n = F.size("errors")
    return df.withColumn("status", F.when(n == 0, "PASS").otherwise("FAIL")).withColumn("score", F.greatest(F.lit(0), 100 - 10 * n).cast("long"))


def error_rows(checked: DataFrame, *keys: str) -> DataFrame:
    return checked.select(*keys, F.posexplode("errors").alias("error_no", "e")).select(*keys, F.col("error_no").cast("int").alias("error_no"), "e.rule_code", "e.field")


def ingested(raw: DataFrame) -> DataFrame:
    """Raw scans (strings) with types, defaults and `accepted`; what isn't accepted belongs in quarantine.

    A name is required. Unknown categories are refused, unknown verdicts become needsReview, numbers
    that don't parse become 0, coordinates count only in pairs, photo_count is at least 1.
    """
    category = F.lower(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("general")))
    number = lambda c, kind: F.coalesce(F.expr(f"try_cast({c} as {kind})"), F.lit(0).cast(kind))
    lat, lng = F.expr("try_cast(lat as double)"), F.expr("try_cast(lng as double)")
    both = lat.isNotNull() & lng.isNotNull()
    return raw.select(
        "id",
        F.trim("product_name").alias("product_name"),
        category.alias("category"),
        F.when(F.col("verdict").isin(vocab.VERDICTS), F.col("verdict")).otherwise("needsReview").alias("verdict"),
        number("score", "double").alias("score"),
        F.greatest(F.lit(1), number("photo_count", "int")).alias("photo_count"),
        number("mean_confidence", "double").alias("mean_confidence"),
        F.when(both, lat).alias("lat"),
        F.when(both, lng).alias("lng"),
        (F.coalesce(F.trim("product_name"), F.lit("")) != "").alias("named"),
        category.isin(vocab.CATEGORIES).alias("known_category"),
    ).withColumn("accepted", F.col("named") & F.col("known_category"))


#: Files of an upload at most, and bytes of one (fixed values).
MOST_FILES, MOST_BYTES = 8, 12 * 1024 * 1024


def uploads(files: DataFrame) -> DataFrame:
    """(scan_id, n_files, n_bytes, accepted, reason): an upload goes as a whole, at the first limit that a file breaks.

    files: scan_id, mime, bytes. Reasons: not_image, too_large, too_many, in this order. A file of
    unknown type is no image; one of unknown size counts as empty.
    """
    size = F.coalesce("bytes", F.lit(0))
    of = files.groupBy("scan_id").agg(F.count("*").alias("n_files"), F.sum(size).cast("long").alias("n_bytes"), F.max(size).alias("__largest"), F.count_if(~F.coalesce(F.col("mime").startswith("image/"), F.lit(False))).alias("__other"))
    reason = F.when(F.col("__other") > 0, "not_image").when(F.col("__largest") > MOST_BYTES, "too_large").when(F.col("n_files") > MOST_FILES, "too_many")
    return of.select("scan_id", "n_files", "n_bytes", reason.isNull().alias("accepted"), reason.alias("reason"))
