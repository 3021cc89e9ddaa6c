"""Second reading of labels whose value was not readable: targets, crops, jobs, parsing, winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions import labels as L
from packlens.operators.extract import blend

#: Jobs a scan at most, fields of variable print, and what a strip (a crop without a label, low on the photo) demands of a pattern (fixed values).
MOST_JOBS = 4
FIELDS = ["batch", "mrp", "mfg", "exp"]
STRIP_TOP, STRIP_PATTERN, FOUND = 0.55, 0.9, 0.7
#: How a crop is prepared and by how much it grows, the most pixels it may then have, and the least side that is read (fixed values).
VARIANTS = {"plain": 3, "contrast": 3, "highContrast": 4}
MOST_PIXELS, LEAST_SIDE = 1_600_000, 8


def targets(observed: DataFrame) -> DataFrame:
    """Unverified observations of variable print that have only their label and its box."""
    return observed.where(F.col("field").isin(FIELDS) & (F.col("status") == "unverified") & (F.col("relationship") == "label_only") & F.col("x1").isNotNull())


def search_rect(found: DataFrame) -> DataFrame:
    """The part of the photo to read again: the label's box, on to the right edge, of a least size."""
    df = found.withColumns({"rx1": F.greatest(F.lit(0.0), F.col("x1") - 0.01), "ry1": F.greatest(F.lit(0.0), F.col("y1") - 0.015), "rx2": F.lit(1.0), "ry2": F.least(F.lit(1.0), F.col("y2") + 0.09)})
    df = df.withColumn("rx1", F.when(F.col("rx2") - F.col("rx1") < 0.12, F.greatest(F.lit(0.0), F.col("rx2") - 0.12)).otherwise(F.col("rx1")))
    return df.withColumn("ry2", F.when(F.col("ry2") - F.col("ry1") < 0.04, F.least(F.lit(1.0), F.col("ry1") + 0.04)).otherwise(F.col("ry2")))


def job_plan(rects: DataFrame, most: int = MOST_JOBS) -> DataFrame:
    """At most `most` jobs a scan, the smallest areas first."""
    area = (F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))
    w = Window.partitionBy("scan_id").orderBy("area", "photo", "field")
    return rects.withColumn("area", area).withColumn("job_no", F.row_number().over(w)).where(F.col("job_no") <= most)


def crops(jobs: DataFrame) -> DataFrame:
    """A row for each variant of each job: left, top, width and height in pixels, scale, and how it is prepared.

    jobs: rx1, ry1, rx2, ry2 as shares, img_w and img_h. Scales shrink to keep crops small; a contrasted
    crop that can't grow is left plain. Crops with a side under 8 pixels are not read and leave no row.
    """
    pixels = lambda share, size: F.floor(F.col(share) * F.col(size) + 0.5).cast("int")
    extent = lambda a, b, size: F.floor((F.col(b) - F.col(a)) * F.col(size) + 0.5).cast("int")
    df = jobs.withColumns({"left": pixels("rx1", "img_w"), "top": pixels("ry1", "img_h"), "width": extent("rx1", "rx2", "img_w"), "height": extent("ry1", "ry2", "img_h")})
    df = df.where((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE))
    within = lambda c, size: F.least(F.greatest(F.col(c), F.lit(0)), (F.col(size) - 1).cast("int"))
    df = df.withColumns({"left": within("left", "img_w"), "top": within("top", "img_h")})
    room_w, room_h = (F.col("img_w") - F.col("left")).cast("int"), (F.col("img_h") - F.col("top")).cast("int")
    df = df.where((room_w >= LEAST_SIDE) & (room_h >= LEAST_SIDE)).withColumns({"width": F.least("width", room_w), "height": F.least("height", room_h)})
    df = df.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("variant"), F.lit(v).alias("wanted"), F.lit(most).alias("most")) for i, (v, most) in enumerate(VARIANTS.items())])).alias("v")).select("*", "v.*").drop("v")
    area, scale = F.col("width").cast("long") * F.col("height"), F.lit(1)
    for n in range(2, max(VARIANTS.values()) + 1):
        scale = F.when((F.col("most") >= n) & (area * n * n <= MOST_PIXELS), n).otherwise(scale)
    df = df.withColumn("scale", scale)
    return df.withColumn("prepared", F.when((F.col("wanted") == "highContrast") & (F.col("scale") < 3), "plain").otherwise(F.col("wanted"))).drop("most")


def parsed(rereads: DataFrame) -> DataFrame:
    """(…, value, pattern): what a second reading's text says for its field, stricter than the first."""
    text = F.col("text")
    batch = F.regexp_extract(text, L.java(r"\b([A-Z0-9][A-Z0-9\-/]{3,23})\b"), 1)
    scrubbed = F.regexp_replace(text, L.PER_UNIT, " ")
    currency, number = F.regexp_extract(scrubbed, "(?i)" + L.PRICE, 1), F.regexp_extract(scrubbed, r"\d[\d,]*(?:\.\d{1,2})?", 0)
    numeric, word = F.regexp_extract(text, L.java(L.DATE_NUMBER, False), 0), F.regexp_extract(text, L.java(L.DATE_WORD), 0)
    is_date = F.col("field").isin("mfg", "exp")
    value = F.when(F.col("field") == "batch", F.when(batch.rlike("[0-9].*[0-9]") & ~F.lower(batch).isin(L.BATCH_STOP), batch)).when(F.col("field") == "mrp", F.nullif(F.regexp_replace(number, ",", ""), F.lit(""))).when(is_date, F.coalesce(F.nullif(numeric, F.lit("")), F.nullif(word, F.lit(""))))
    pattern = F.when(F.col("field") == "batch", 0.9).when(F.col("field") == "mrp", F.when(currency != "", 0.95).otherwise(0.7)).otherwise(F.when(numeric != "", 0.95).otherwise(0.8))
    return rereads.withColumn("value", value).withColumn("pattern", pattern)


def winners(read: DataFrame) -> DataFrame:
    """The best variant of each field: found from 0.7, else unverified.

    Where read has the crop's left and top (rx1, ry1), a strip has no label, so a weak pattern doesn't count there.
    """
    w = Window.partitionBy("scan_id", "field").orderBy(F.desc("confidence"), "job_no", "variant")
    df = parsed(read).where("value is not null")
    if {"rx1", "ry1"} <= set(read.columns):
        strip = (F.col("ry1") >= STRIP_TOP) & (F.col("rx1") == 0) & (F.col("field") != "batch")
        df = df.where(~F.coalesce(strip, F.lit(False)) | (F.col("pattern") >= STRIP_PATTERN))
    df = df.withColumn("confidence", blend(F.col("pattern"), F.col("conf")))
    df = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    return df.withColumn("status", F.when(F.col("confidence") >= FOUND, "found").otherwise("unverified")).withColumn("relationship", F.lit("variable_crop"))


def improved(observed: DataFrame, won: DataFrame) -> DataFrame:
    """observed (one row a scan_id and field) with the winners in place of what they beat: a lower status, or the same with less confidence.

    Columns that winners lack are null in their rows.
    """
    names = [c for c in observed.columns if c not in ("scan_id", "field")]
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, ("notFound", "unverified", "found"))), c), F.lit(0))
    new = won.select("scan_id", "field", F.struct(*[(F.col(c) if c in won.columns else F.lit(None)).cast(observed.schema[c].dataType).alias(c) for c in names]).alias("new"))
    old = observed.select("scan_id", "field", F.struct(*names).alias("old"))
    a, b = rank(F.col("new.status")), rank(F.col("old.status"))
    better = F.col("old").isNull() | (a > b) | ((a == b) & (F.col("new.confidence") > F.col("old.confidence")))
    df = old.join(new, ["scan_id", "field"], "full").withColumn("got", F.when(F.col("new").isNotNull() & better, F.col("new")).otherwise(F.col("old")))
    return df.select("scan_id", "field", "got.*").select(*observed.columns)
