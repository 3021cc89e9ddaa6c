"""What rules say in words, on hand-made observations."""

from pyspark.sql import functions as F

from packlens.functions import vocab
from packlens.operators import findings

SCAN = "id long, category string, ocr_text string, mean_confidence double, total_chars int, region_count int"
OBSERVED = "scan_id long, field string, status string, value string, data map<string,string>, label string, evidence string, photo_index int, note string, relationship string"
GOOD, POOR = (0.86, 1200, 40), (0.4, 50, 3)


def say(spark, capture, *observed, text="", category="general"):
    scans = spark.createDataFrame([(1, category, text, *capture)], SCAN)
    return {r.code: r for r in findings.findings(scans, spark.createDataFrame([(1, *o) for o in observed], OBSERVED)).collect()}


def test_a_gap_on_a_poor_capture_asks_for_another_photo(spark):
    got = say(spark, POOR)
    assert got["LM-R6-DATE-MFG"].message == "Could not verify — month/year of manufacture/packing/import not detected and the capture is too weak to prove absence."
    assert got["LM-R6-NETQ"].message == "Could not verify — net quantity declaration not detected and the capture is too weak to prove absence (see capture quality below)."
    assert got["LM-R6-NETQ"].action == "Capture a closer, flat, glare-free photo of the net-quantity panel and re-scan."
    assert (got["LM-READ-QUALITY"].evidence, got["LM-READ-QUALITY"].message[:24]) == ("meanConfidence=0.40", "Low OCR confidence (40%)")
    sure = say(spark, GOOD)
    assert (sure["LM-R6-NETQ"].status, sure["LM-R6-NETQ"].action) == ("fail", None)
    assert sure["LM-R6-DATE-EXP"].message.startswith("Not detected") and sure["LM-R6-DATE-EXP"].field == "expDate"


def test_found_values_are_shown(spark):
    got = say(
        spark,
        GOOD,
        ("mrp", "found", "Rs. 42.50", {"value": "42.5"}, "MRP", "Rs. 42.50", 1, None, "variable_crop"),
        ("manufacturer", "found", "X Ltd", {"role": "packer", "address": "Plot 7, Pune 411001"}, "Packed by", "X Ltd", 0, None, None),
        ("genericName", "unverified", "Potato Chips {}", None, None, "Potato Chips", 0, None, None),
        ("batch", "unverified", None, None, "Batch", "Batch No", 2, "dots only", None),
        ("carePhone", "found", "1800", None, None, "call 1800", 3, None, None),
        ("careEmail", "notFound", None, None, None, None, None, None, None),
        ("netQty", "unverified", "9", None, "Net", "9", 0, None, None),
        text="MRP and m.r.p. of imported goods",
    )
    assert (got["LM-R6-MRP"].message, got["LM-R6-MRP"].evidence, got["LM-R6-MRP"].photo_index) == ("MRP ₹42.50 detected (dot-matrix re-read).", "MRP: Rs. 42.50", 1)
    assert (got["LM-R6-NAME"].message, got["LM-R6-NAME"].evidence) == ("Packer name and address found.", "X Ltd")
    assert got["LM-R6-COMMON"].message.startswith('A likely product name ("Potato Chips {}") needs')
    assert (got["LM-R6-BATCH"].message, got["LM-R6-BATCH"].evidence, got["LM-R6-BATCH"].photo_index) == ("dots only", "Batch No", 2)
    assert got["LM-R6-CARE"].message.startswith("Partial — found phone") and got["LM-R6-CARE"].photo_index == 3
    assert (got["LM-R6-NETQ"].status, got["LM-R6-NETQ"].evidence, got["LM-R6-NETQ"].photo_index) == ("fail", None, None)
    assert got["LM-R9-SINGLE-MRP"].evidence == "Mentions: 2"
    assert got["LM-R6-ORIGIN"].action.endswith("origin declaration and re-scan.")


def test_every_result_has_a_message(spark):
    scans = spark.createDataFrame([(i, c, t, m, 200, n) for i, (c, t, m, n) in enumerate((c, t, m, n) for c in vocab.CATEGORIES for t in (None, "mrp mrp import") for m in (None, 0.3, 0.6, 0.9) for n in (1, 9))], SCAN)
    fields = scans.select(F.col("id").alias("scan_id"), F.explode(F.array(*map(F.lit, vocab.FIELDS))).alias("field"))
    for status in (*vocab.FIELD_STATUSES, None):
        observed = fields.select("*", F.lit(status).cast("string").alias("status"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("map<string,string>").alias("data"))
        got = findings.findings(scans, observed)
        assert got.where("message is null or title is null").count() == 0 and got.select("id").distinct().count() == scans.count()
    assert findings.findings(scans.limit(0), observed).count() == 0
