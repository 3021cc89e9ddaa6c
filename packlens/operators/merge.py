"""Merging observations of photos and runs, officers' corrections, and the stored report JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions import vocab

#: Units as written on labels and the units they stand for (fixed values).
UNITS = {
    "mg": "mg", "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g", "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg",
    "ml": "mL", "cl": "cL", "dl": "dL", "l": "L", "litre": "L", "litres": "L", "liter": "L", "liters": "L", "pcs": "pcs", "piece": "pcs", "pieces": "pcs",
}
#: Legacy report keys and their fields.
LEGACY = {"genericName": "genericName", "mrpRaw": "mrp", "netQtyRaw": "netQty", "mfgRaw": "mfg", "expRaw": "exp", "manufacturerName": "manufacturer", "carePhone": "carePhone", "careEmail": "careEmail", "originRaw": "origin", "batchRaw": "batch", "fssaiRaw": "fssai"}


def rank(status: Column) -> Column:
    return F.when(status == "found", 2).when(status == "unverified", 1).otherwise(0)


def best(rows: DataFrame, *order: Column | str) -> DataFrame:
    w = Window.partitionBy("scan_id", "field").orderBy(rank(F.col("status")).desc(), F.desc("confidence"), *order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merged(observed: DataFrame) -> DataFrame:
    """The best observation of each field over photos: by status, then confidence, then the earlier photo."""
    return best(observed, "photo_index", "value")


def ensemble(plain: DataFrame, voted: DataFrame) -> DataFrame:
    """The best observation over two runs, the first on ties."""
    return best(plain.unionByName(voted), "run_no", "value").withColumn("merged_from", F.lit(2))


def price(text: Column) -> Column:
    """The first number of a text, thousands' commas dropped."""
    return F.regexp_replace(F.regexp_extract(text, r"\d[\d,]*(?:\.\d{1,2})?", 0), ",", "").try_cast("double")


def quantity(text: Column) -> tuple[Column, Column]:
    """(number, unit) of the first quantity with a known unit in a text."""
    pattern = r"(?i)(\d+(?:[.,]\d+)?)\s*(mg|gms?|grams?|g|kilograms?|kgs?|ml|cl|dl|litres?|liters?|l|pcs|pieces?)(?![A-Za-z0-9_])"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(F.regexp_extract(text, pattern, 2)))
    ok = unit.isNotNull() & (number > 0) & (number < 1e6)
    return F.when(ok, number), F.when(ok, unit)


def corrected(observed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Observations with an officer's texts: blank clears a field, other text is found at 0.95.

    Prices and quantities are read again into number and unit; manufacturerAddress only sets address.
    """
    texts = corrections.where("field <> 'manufacturerAddress'").select("scan_id", "field", F.trim("text").alias("__text"))
    addresses = corrections.where("field = 'manufacturerAddress' and trim(text) <> ''").select("scan_id", F.lit("manufacturer").alias("field"), F.trim("text").alias("address"))
    df = observed.join(texts, ["scan_id", "field"], "left").join(addresses, ["scan_id", "field"], "left")
    t = F.col("__text")
    given, blank = t.isNotNull(), t == ""
    number, unit = quantity(t)
    return df.select(
        "scan_id",
        "field",
        "photo_index",
        F.when(~given, F.col("status")).when(blank, "notFound").otherwise("found").alias("status"),
        F.when(~given, F.col("value")).when(~blank, t).alias("value"),
        F.when(~given, F.col("confidence")).when(blank, 0.0).otherwise(0.95).alias("confidence"),
        F.when(given & (F.col("field") == "mrp"), price(t)).when(given & (F.col("field") == "netQty"), number).alias("number"),
        F.when(given & (F.col("field") == "netQty"), unit).alias("unit"),
        "address",
    )


# --- stored reports

V2 = "struct<v:int,fields:map<string,struct<status:string,value:string,fieldConfidence:double>>>"
V1 = "struct<" + ",".join(f"{k}:string" for k in LEGACY) + ",fieldConfidence:map<string,double>>"


def encoded(observed: DataFrame) -> DataFrame:
    """(scan_id, report): a version 2 report of each scan's observations."""
    field = F.struct("field", F.struct("status", "value", F.col("confidence").alias("fieldConfidence")))
    df = observed.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(field)).alias("fields"))
    return df.select("scan_id", F.to_json(F.struct(F.lit(2).alias("v"), "fields")).alias("report"))


def decoded(reports: DataFrame, key: str, report: str) -> DataFrame:
    """(key, field, status, value, confidence, method) of stored reports of version 2 or the legacy form.

    Unknown statuses are not found. Legacy values are found unless blank, at 0.5 without a
    confidence. Reports that don't parse have no rows.
    """
    new, old = F.from_json(report, V2), F.from_json(report, V1)
    df = reports.select(key, new.alias("new"), old.alias("old"))
    entries = F.transform(
        F.map_entries("new.fields"),
        lambda e: F.struct(e["key"].alias("field"), F.when(e["value"]["status"].isin(vocab.FIELD_STATUSES), e["value"]["status"]).otherwise("notFound").alias("status"), e["value"]["value"].alias("value"), F.coalesce(e["value"]["fieldConfidence"], F.lit(0.0)).alias("confidence"), F.lit("candidatePattern").alias("method")),
    )
    legacy = F.array_compact(
        F.array(
            *[
                F.when(F.col(f"old.{k}").isNotNull(), F.struct(F.lit(f).alias("field"), F.when(F.trim(f"old.{k}") == "", "notFound").otherwise("found").alias("status"), F.col(f"old.{k}").alias("value"), F.coalesce(F.try_element_at("old.fieldConfidence", F.lit(f)), F.lit(0.5)).alias("confidence"), F.lit("legacyImport").alias("method")))
                for k, f in LEGACY.items()
            ]
        )
    )
    is_new = (F.col("new.v") == 2) & F.col("new.fields").isNotNull()
    return df.select(key, F.explode(F.when(is_new, entries).otherwise(legacy)).alias("o")).select(key, "o.*")
