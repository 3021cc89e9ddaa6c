"""Three-state rules over merged observations, without a shuffle beyond the one that gathers a scan's fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import vocab
from packlens.functions.text import bound

MIN_CONFIDENCE, MIN_CHARS, MIN_REGIONS = 0.55, 150, 8
RESULT = "struct<rule_seq:int,code:string,status:string,severity:string>"
#: Mentions of a maximum retail price.
MENTION = r"(?i)(maximum\s+retail\s+price|(?<![A-Za-z0-9_])mrp(?![A-Za-z0-9_])|m\s*\.\s*r\s*\.\s*p\s*\.?)"
TAX_PHRASE = r"(?i)inclusive\s+of\s+all\s+taxes?"


def adequate(scans: DataFrame) -> DataFrame:
    """Whether a capture is good enough to prove that something is absent."""
    good = (F.col("mean_confidence") >= MIN_CONFIDENCE) & (F.col("total_chars") >= MIN_CHARS) & (F.col("region_count") >= MIN_REGIONS)
    return scans.withColumn("adequate", good)


def by_field(observed: DataFrame, *more: str) -> DataFrame:
    """One row a scan with a map from field to (status, value, data and more)."""
    return observed.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("status", "value", "data", *more)))).alias("fields"))


def evaluated(scans: DataFrame, observed: DataFrame, font_review: bool = True, more: Sequence[str] = ()) -> DataFrame:
    """Scans with `results`, in the order of the rules; rules that don't apply leave none.

    scans: id, category, ocr_text, mean_confidence, total_chars, region_count. observed: at most one
    observation a (scan_id, field); a missing one is not found. Unverified quantity, licence and
    origin count as absent. Without font_review, scans can be compliant. Where more columns of observed
    are named, the map `fields` stays, with them.
    """
    df = adequate(scans).join(by_field(observed, *more).withColumnRenamed("scan_id", "id"), "id", "left")
    status = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f))["status"], F.lit("notFound"))
    data = lambda f, k: F.try_element_at(F.try_element_at("fields", F.lit(f))["data"], F.lit(k))
    found, glimpsed = lambda f: status(f) == "found", lambda f: status(f) == "unverified"
    text = F.coalesce("ocr_text", F.lit(""))
    out = lambda s, severity: F.struct(F.lit(s).alias("status"), F.lit(severity).alias("severity"))
    passed, warned, unclear, review = out("pass", "info"), out("warning", "warning"), out("unverified", "warning"), out("manualReview", "warning")
    absent = F.when(F.col("adequate"), out("fail", "error")).otherwise(out("unverified", "error"))
    address = F.length(F.trim(F.coalesce(data("manufacturer", "address"), F.lit("")))) >= 8
    phone, email = found("carePhone"), found("careEmail")
    confidence = F.col("mean_confidence")
    imported = F.coalesce(data("manufacturer", "role") == "importer", F.lit(False)) | text.rlike("(?i)import")
    outcome = {
        "LM-R6-NAME": F.when(found("manufacturer"), F.when(address, passed).otherwise(warned)).when(glimpsed("manufacturer"), unclear).otherwise(absent),
        "LM-R6-COMMON": F.when(found("genericName"), passed).when(glimpsed("genericName"), unclear).otherwise(absent),
        "LM-R6-NETQ": F.when(found("netQty"), passed).otherwise(absent),
        "LM-R6-DATE-MFG": F.when(found("mfg"), passed).when(glimpsed("mfg"), unclear).otherwise(absent),
        "LM-R6-DATE-EXP": F.when(found("exp"), passed).when(glimpsed("exp"), unclear).otherwise(warned),
        "LM-R6-MRP": F.when(found("mrp"), passed).when(glimpsed("mrp"), unclear).otherwise(absent),
        "LM-R6-MRP-TAX": F.when(found("mrp"), F.when(text.rlike(TAX_PHRASE), passed).otherwise(warned)),
        "LM-R9-SINGLE-MRP": F.when(found("mrp") & (F.regexp_count(text, F.lit(MENTION)) >= 2), review),
        "LM-R6-CARE": F.when(phone & email, passed).when(phone | email | glimpsed("carePhone") | glimpsed("careEmail"), F.when(F.col("adequate") & ~phone & ~email, warned).otherwise(unclear)).otherwise(absent),
        "LM-R6-ORIGIN": F.when(imported, F.when(found("origin"), passed).otherwise(absent)),
        "LM-R6-BATCH": F.when(found("batch"), passed).when(glimpsed("batch"), unclear).otherwise(warned),
        "LM-FOOD-FSSAI": F.when(F.col("category") == "food", F.when(found("fssai"), passed).otherwise(absent)),
        "LM-READ-QUALITY": F.when((confidence > 0) & (confidence < 0.5), unclear).when((confidence >= 0.5) & (confidence < 0.65), warned),
        "LM-R7-FONT": review if font_review else F.lit(None).cast("struct<status:string,severity:string>"),
    }
    row = lambda i, c, o: F.when(o.isNotNull(), F.struct(F.lit(i).alias("rule_seq"), F.lit(c).alias("code"), o["status"].alias("status"), o["severity"].alias("severity")))
    # each outcome is computed once, its null, status and severity are asked for apart
    results = bound([outcome[c] for c in vocab.CODES], lambda *os: F.array_compact(F.array(*[row(i, c, o) for i, (c, o) in enumerate(zip(vocab.CODES, os, strict=True))])))
    return df.withColumn("results", results).drop(*[] if more else ["fields"])


def exploded(df: DataFrame, *columns: str) -> DataFrame:
    """columns and `r`, a row a result. An outer explode, as a plain one has Spark compute the results again to filter by their number."""
    return df.select(*columns, F.explode_outer("results").alias("r")).where(F.col("r").isNotNull())


def score(results: Column) -> Column:
    def lost(r: Column) -> Column:
        s = r["status"]
        return F.when(s == "fail", F.when(r["severity"] == "error", 15).otherwise(10)).when(s.isin("warning", "unverified"), 5).when(s == "manualReview", 3).otherwise(0)

    return F.greatest(F.lit(0), 100 - F.aggregate(results, F.lit(0), lambda n, r: n + lost(r))).cast("long")


def verdict(results: Column) -> Column:
    return F.when(F.exists(results, lambda r: r["status"] == "fail"), "nonCompliant").when(F.exists(results, lambda r: r["status"] != "pass"), "needsReview").otherwise("compliant")
