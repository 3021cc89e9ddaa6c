"""Hand-made labels with the values that must come out, and the parts' edge cases."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from packlens.functions import text as T
from packlens.operators import classify, extract, layout, merge, reporting, rules, validation

LINES = "scan_id long, photo int, line_no int, block_no int, text string, conf double, cy double, top double, vote_class string, vote_prob double"


def label(spark, *texts, step=0.1, votes=None, blocks=None):
    votes = votes or {}
    rows = [(1, 0, i, (blocks or {}).get(i, i), t, 0.95, 0.1 + i * step, 0.09 + i * step, *votes.get(i, (None, None))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LINES)


def one(df):
    found = df.collect()
    assert len(found) <= 1
    return found[0] if found else Row(status="notFound", value=None, number=None, unit=None, confidence=None, relationship=None)


def test_price_skips_the_unit_price_and_needs_a_label(spark):
    assert one(extract.price(label(spark, "MRP Rs. 15.00 (0.16/g)"))).number == 15
    assert one(extract.price(label(spark, "8901595863020"))).status == "notFound"
    alone = one(extract.price(label(spark, "MRP", "xx", step=0.2)))
    assert (alone.status, alone.relationship, alone.confidence) == ("unverified", "label_only", 0.5)
    near = one(extract.price(label(spark, "M.R.P.", "Rs. 42.00", step=0.05)))
    assert (near.number, near.relationship) == (42, "nearby")


def test_votes_rescue_a_garbled_price(spark):
    assert one(extract.price(label(spark, "MPP Rs 42.00"))).status == "notFound"
    assert one(extract.price(label(spark, "MPP Rs 42.00", votes={0: ("mrp", 1.0)}))).number == 42


def test_net_quantity_wrapped_and_never_in_a_serving(spark):
    got = one(extract.net_quantity(label(spark, "NET", "90g", "WEIGHT:", step=0.02, blocks=dict.fromkeys(range(3), 0))))
    assert (got.number, got.unit) == (90, "g")
    assert one(extract.net_quantity(label(spark, "Net Qty", "Per 100 g serving", step=0.05))).status == "notFound"
    assert one(extract.net_quantity(label(spark, "Net Qty: 10 tablets"))).status == "notFound"


def test_batch_dates_contacts(spark):
    assert one(extract.batch(label(spark, "BATCH NUMBER"))).status == "unverified"
    assert one(extract.batch(label(spark, "Batch No. PP6E110015"))).value == "PP6E110015"
    assert one(extract.date(label(spark, "DATE OF MFG.: 11/05/26"), "mfg")).value == "11/05/26"
    assert one(extract.date(label(spark, "DATE OF MFG.: xx/yy/zz", "a"), "mfg")).status == "unverified"
    assert one(extract.date(label(spark, "Mfg Date: 01/2024", "a"), "mfg")).status == "unverified"
    assert one(extract.phone(label(spark, "Customer care 022- 67740100"))).value == "022-67740100"
    assert one(extract.phone(label(spark, "890159586302 0"))).status == "notFound"
    assert one(extract.email(label(spark, "40100ANDCUSTOMERCARE@CAPITALFOODS.CO.IN"))).value == "CUSTOMERCARE@CAPITALFOODS.CO.IN"
    assert one(extract.fssai(label(spark, "Lic. No. 10013022001865"))).value == "10013022001865"
    assert one(extract.fssai(label(spark, "10013022001865"))).status == "notFound"
    assert one(extract.barcode(label(spark, "8901595863020"))).value == "8901595863020"
    assert one(extract.origin(label(spark, "Made in sri-lanka, for x"))).value == "Sri-lanka"


def test_manufacturer_stops_at_the_next_label(spark):
    got = one(extract.manufacturer(label(spark, "Manufactured by", "CAPITAL FOODS LTD", "Plot 7, Pune 411001", "USE STORE COOL: yes", blocks=dict.fromkeys(range(4), 0))))
    assert (got.value, got.unit) == ("CAPITAL FOODS LTD", "Plot 7, Pune 411001")


def test_rules_hold_back_without_an_adequate_capture(spark):
    scans = spark.createDataFrame([(1, "food", "", 0.86, 1200, 40), (2, "food", "", 0.4, 50, 3)], "id long, category string, ocr_text string, mean_confidence double, total_chars int, region_count int")
    none = spark.createDataFrame([], "scan_id long, field string, status string, value string, data map<string,string>")
    got = {r.id: r for r in rules.evaluated(scans, none).select("id", "results", rules.score(F.col("results")).alias("score"), rules.verdict(F.col("results")).alias("verdict")).collect()}
    status = {i: {x.code: x.status for x in r.results} for i, r in got.items()}
    assert status[1]["LM-R6-DATE-MFG"] == "fail" and status[2]["LM-R6-DATE-MFG"] == "unverified"
    assert got[1].verdict == "nonCompliant" and got[2].verdict == "needsReview" and got[1].score == 0
    assert status[2]["LM-READ-QUALITY"] == "unverified" and "LM-READ-QUALITY" not in status[1]


@pytest.mark.parametrize(
    "raw,clean",
    [("'8'", "8"), ("'0'.'1''9'", "0.19"), ('"Pack<"', "Pack<"), ("Lay's", "Lay's"), ("'5''3''7'kcd", "537 kcal"), ("80g", "80 g"), ("5 %", "5%"), ("", ""), ("(x", "x"), ("a)", "a")],
)
def test_clean_token(spark, raw, clean):
    assert spark.createDataFrame([(raw,)], "t string").select(T.clean_token(F.col("t")).alias("c")).first().c == clean


@pytest.mark.parametrize("raw,fixed", [("Sodum", "Sodium"), ("Protoin", "Protein"), ("Enengy", "Energy"), ("ALLERGENADVICE:ContainsSoy Mak", "ALLERGEN ADVICE: Contains Soy Milk"), ("Oil(Palm)", "Oil (Palm)"), ("Per 100g", "Per 100g")])
def test_fixed_line(spark, raw, fixed):
    assert spark.createDataFrame([(raw,)], "t string").select(T.fixed_line(F.col("t")).alias("c")).first().c == fixed


def test_two_label_rows_stay_two_lines(spark):
    box = "scan_id long, photo int, token_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double, img_w double, img_h double"
    rows = [(1, 0, 0, "NET WEIGHT", 0.9, 10.0, 515.0, 200.0, 535.0, 1000.0, 1000.0), (1, 0, 1, "MRP", 0.9, 10.0, 550.0, 100.0, 570.0, 1000.0, 1000.0), (1, 0, 2, "90g", 0.9, 210.0, 516.0, 260.0, 536.0, 1000.0, 1000.0), (1, 0, 3, ".", 0.9, 1.0, 1.0, 3.0, 3.0, 1000.0, 1000.0)]
    got = layout.lines(spark.createDataFrame(rows, box)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["NET WEIGHT 90g", "MRP"]
    assert layout.lines(spark.createDataFrame([], box)).count() == 0


def test_corrections_and_quantities(spark):
    rows = [(1, "mrp", 0, "found", "Rs. 42", 0.9)]
    observed = spark.createDataFrame(rows, "scan_id long, field string, photo_index int, status string, value string, confidence double")
    cleared = merge.corrected(observed, spark.createDataFrame([(1, "mrp", "  ")], "scan_id long, field string, text string")).first()
    assert (cleared.status, cleared.value) == ("notFound", None)
    again = merge.corrected(observed, spark.createDataFrame([(1, "mrp", "Rs. 99")], "scan_id long, field string, text string")).first()
    assert (again.status, again.number, again.confidence) == ("found", 99, 0.95)


def test_pages_and_urls():
    assert reporting.page_bounds(None, None) == (1, 20)
    assert reporting.page_bounds("0", "500") == (1, 100)
    assert reporting.page_bounds("x", "-3") == (1, 1)


def test_trained_classifier_knows_its_lines(spark):
    rows = [(i, f"MRP Rs. {i}.00 inclusive", "mrp") for i in range(6)] + [(i + 6, f"Net Qty: {i} g", "net_qty") for i in range(6)] + [(i + 12, f"Batch No. B{i}", "batch") for i in range(6)]
    lines = spark.createDataFrame(rows, "id long, text string, label string")
    idf, weights, bias = classify.trained(lines, ["batch", "mrp", "net_qty"])
    got = {r.id: r for r in classify.scored(lines, idf, weights, bias, "id").collect()}
    assert all(got[i].vote_class == k and got[i].vote_prob >= 0.45 for i, _, k in rows)


def test_ingest_defaults(spark):
    raw = spark.createDataFrame([(1, " a ", None, "odd", "x", None, None, "1", None), (2, " ", "toys", None, "5", "3", "0.5", "1", "2")], "id long, product_name string, category string, verdict string, score string, photo_count string, mean_confidence string, lat string, lng string")
    a, b = validation.ingested(raw).orderBy("id").collect()
    assert (a.accepted, a.category, a.verdict, a.score, a.photo_count, a.lat) == (True, "general", "needsReview", 0, 1, None)
    assert (b.accepted, b.photo_count, b.lng) == (False, 3, 2)
