"""Whole labels from tokens to lines, blocks, fields and rules, with the values that must come out."""

import pytest
from pyspark.sql import functions as F

from packlens.operators import extract, findings, layout, merge

TOKEN = "scan_id long, photo int, token_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double, img_w double, img_h double"
#: Tokens of two labels: text, confidence, left, top, width, height on a photo of 1000 by 1000 (fixed values).
KETCHUP = [
    ("SMITH & JONES", 0.98, 100, 20, 800, 120),
    ("Tomato Ketchup", 0.97, 300, 150, 400, 80),
    ("INGREDIENTS: Water, Tomato Paste (25%), Sugar,", 0.93, 80, 240, 840, 30),
    ("Iodised Salt, Acidity Regulator (INS 260),", 0.90, 80, 275, 520, 25),
    ("ALLERGEN ADVICE: May contain Wheat, Nuts,", 0.92, 80, 310, 840, 25),
    ("BATCH NO.:", 0.90, 80, 420, 220, 25),
    ("PP6E110015", 0.62, 320, 420, 330, 30),
    ("MRP Rs:", 0.90, 80, 455, 170, 25),
    ("15", 0.60, 270, 455, 70, 25),
    ("(Rs. 0.16/g)", 0.70, 350, 455, 200, 25),
    ("DATE OF MFG.:", 0.88, 80, 490, 220, 25),
    ("11/05/26", 0.60, 320, 490, 240, 30),
    ("USE BY:", 0.88, 80, 525, 140, 25),
    ("10/05/27", 0.60, 240, 525, 230, 30),
    ("BRAND OWNED & MARKETED BY:", 0.90, 80, 560, 270, 25),
    ("CAPITAL FOODS PVT. LTD.,", 0.90, 360, 560, 590, 25),
    ("VILLA CAPITAL, SADHANA COMPOUND,", 0.88, 80, 590, 870, 25),
    ("MUMBAI - 400 102.", 0.88, 80, 620, 520, 25),
    ("Lic. No. 10013022001865", 0.88, 620, 588, 330, 24),
    ("FOR ANY COMPLAINT CONTACT MANAGER CONSUMER", 0.85, 80, 650, 870, 25),
    ("C022- 67740100 AND", 0.70, 80, 680, 420, 25),
    ("CUSTOMERCARE@CAPITALFOODS.CO.IN", 0.85, 510, 680, 440, 25),
    ("NET", 0.90, 80, 715, 220, 25),
    ("WEIGHT:", 0.90, 80, 745, 220, 25),
    ("90g", 0.95, 320, 715, 100, 55),
    ("8 901595 863020", 0.97, 80, 800, 870, 30),
    ("Smith & Jones is Registered Trademark of", 0.90, 80, 900, 870, 25),
    ("Capital Foods Pvt. Ltd. India.", 0.90, 80, 930, 520, 25),
]
CHIPS = [
    ("Lay's", 0.98, 100, 30, 400, 90),
    ("Potato Chips", 0.97, 100, 130, 500, 80),
    ("Lay's is a Trade Mark of PepsiCo, Inc.", 0.90, 80, 230, 820, 30),
    ("NET QTY:", 0.90, 80, 300, 220, 25),
    ("80g", 0.94, 320, 300, 100, 25),
    ("MRP Rs. 42.00", 0.90, 80, 340, 420, 25),
    ("(inclusive of all taxes)", 0.88, 300, 340, 400, 25),
    ("Mfd. by PepsiCo India Holdings Pvt. Ltd.,", 0.90, 80, 380, 870, 25),
    ("SCO 29-30, Sector 17, Chandigarh 160017", 0.88, 80, 410, 620, 25),
    ("1800224020", 0.85, 80, 450, 420, 25),
    ("CONSUMER.FEEDBACK@PEPSICO.COM", 0.90, 520, 450, 430, 25),
    ("FSSAI Lic. No. 10012083000110", 0.90, 80, 490, 870, 25),
    ("1001208300010", 0.96, 80, 800, 870, 30),
]


@pytest.fixture(scope="module")
def fields(spark):
    rows = [(scan, 0, i, text, conf, float(x), float(y), float(x + w), float(y + h), 1000.0, 1000.0) for scan, label in ((1, KETCHUP), (2, CHIPS)) for i, (text, conf, x, y, w, h) in enumerate(label)]
    lines = layout.blocks(layout.lines(spark.createDataFrame(rows, TOKEN)))
    best = merge.merged(extract.product(lines).withColumn("photo_index", F.col("photo"))).cache()
    return best, {(r.scan_id, r.field): r for r in best.collect()}


def found(fields, scan, field):
    row = fields[1].get((scan, field))
    return row if row and row.status == "found" else None


def test_ketchup(fields):
    value = {f: r.value for (scan, f), r in fields[1].items() if scan == 1 and r.status == "found"}
    assert (value.get("brand"), value.get("productName"), value.get("genericName")) == ("SMITH & JONES", "Tomato Ketchup", "Tomato Ketchup")
    assert (found(fields, 1, "netQty").number, found(fields, 1, "netQty").unit) == (90, "g")
    assert found(fields, 1, "mrp").number == 15
    assert value.get("batch") == "PP6E110015" and "11/05/26" in value.get("mfg", "") and "10/05/27" in value.get("exp", "")
    assert "CAPITAL FOODS" in value.get("manufacturer", "")
    assert (value.get("carePhone"), value.get("careEmail")) == ("022-67740100", "CUSTOMERCARE@CAPITALFOODS.CO.IN")
    assert (value.get("fssai"), value.get("barcode")) == ("10013022001865", "8901595863020")


def test_chips(fields):
    value = {f: r.value for (scan, f), r in fields[1].items() if scan == 2 and r.status == "found"}
    assert (value.get("brand"), value.get("productName")) == ("Lay's", "Potato Chips")
    assert (found(fields, 2, "netQty").number, found(fields, 2, "mrp").number) == (80, 42)
    assert (value.get("barcode"), value.get("fssai"), value.get("carePhone")) == ("1001208300010", "10012083000110", "1800224020")
    mail = fields[1][2, "careEmail"]  # no care label near it, so 0.66 at most
    assert (mail.value, mail.status, mail.confidence) == ("CONSUMER.FEEDBACK@PEPSICO.COM", "unverified", 0.66)


def test_an_adequate_ketchup_fails_no_rule(spark, fields):
    scans = spark.createDataFrame([(1, "food", "MRP Rs: 15", 0.86, 1200, 40)], "id long, category string, ocr_text string, mean_confidence double, total_chars int, region_count int")
    data = F.create_map(F.lit("address"), F.when(F.col("field") == "manufacturer", F.col("unit")), F.lit("role"), extract.role(F.col("label")), F.lit("value"), F.col("number").cast("string"))
    got = {r.code: r for r in findings.findings(scans, fields[0].where("scan_id = 1").withColumn("data", data).withColumn("evidence", F.col("value"))).collect()}
    assert [c for c, r in got.items() if r.status == "fail"] == []
    assert got["LM-R6-MRP"].message == "MRP ₹15 detected."
