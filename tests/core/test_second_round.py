"""Votes, second readings merged back, and an outbox with rows that land late."""

from pyspark.sql import functions as F

from packlens.operators import extract, reread
from packlens.streaming import outbox

LINE = "scan_id long, photo int, line_no int, block_no int, text string, conf double, cy double, top double, vote_class string, vote_prob double"


def lines(spark, *rows):
    return spark.createDataFrame([(1, 0, i, 0, t, 0.9, i / 20, i / 20, c, p) for i, (t, c, p) in enumerate(rows)], LINE)


def test_votes_open_the_gate_of_licences_and_blocks(spark):
    rows = [("fssi lc no", "fssai", 0.5), ("10013022001865", None, None)]
    assert extract.fssai(lines(spark, *rows)).first().value == "10013022001865"
    assert extract.fssai(lines(spark, ("fssi lc no", "fssai", 0.4), rows[1])).count() == 0
    voted = ("lngredlents wheat flour, salt", "ingredients", 0.7)
    got = extract.block_field(lines(spark, voted, ("and sugar", None, None)), "ingredients", r"^\s*ingredients?(?![A-Za-z0-9_])", "ingredients").first()
    assert (got.value, got.relationship, got.label) == ("lngredlents wheat flour, salt and sugar", "classifier_block_capture", None)
    weak = (*voted[:2], 0.55)
    assert extract.block_field(lines(spark, weak), "ingredients", r"^\s*ingredients?(?![A-Za-z0-9_])", "ingredients").count() == 0


def test_second_readings(spark):
    rows = [
        (1, "mrp", "Rs. 45.00", 0.6, 0, 0, 0.1, 0.2),
        (1, "mrp", "45", 0.9, 0, 1, 0.1, 0.2),
        (2, "mrp", "45", 0.9, 0, 0, 0.0, 0.6),  # a strip: no currency, too weak
        (2, "exp", "12/05/2027", 0.9, 1, 0, 0.0, 0.6),
    ]
    read = spark.createDataFrame(rows, "scan_id long, field string, text string, conf double, job_no int, variant int, rx1 double, ry1 double")
    won = reread.winners(read)
    got = {(r.scan_id, r.field): (r.value, r.confidence, r.status) for r in won.collect()}
    # 0.95 * (0.55 + 0.45 * 0.6) and 0.95 * (0.55 + 0.45 * 0.9)
    assert got == {(1, "mrp"): ("45.00", 0.78, "found"), (2, "exp"): ("12/05/2027", 0.91, "found")}
    observed = spark.createDataFrame([(1, "mrp", "unverified", None, 0.5, "label_only"), (2, "exp", "found", "01/01/2026", 0.95, "nearby")], "scan_id long, field string, status string, value string, confidence double, relationship string")
    merged = {(r.scan_id, r.field): (r.value, r.relationship) for r in reread.improved(observed, won).collect()}
    assert merged == {(1, "mrp"): ("45.00", "variable_crop"), (2, "exp"): ("01/01/2026", "nearby")}


def test_outbox_keeps_late_rows_and_sends_each_once(spark, tmp_path):
    schema = "id long, created_at timestamp, synced boolean"
    land = lambda *rows: spark.createDataFrame(rows, "id long, at string, synced boolean").select("id", F.col("at").cast("timestamp").alias("created_at"), "synced").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain = lambda: outbox.drained(outbox.landed(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    land((1, "2026-01-02 12:00:00", False), (9, "2026-01-02 12:00:00", True))
    drain()
    land((2, "2026-01-01 00:00:00", False), (3, "2026-01-03 00:00:00", False), (1, "2026-01-02 12:00:00", False))
    drain()
    got = spark.read.parquet(*[f"{tmp_path}/out/batch={i}" for i in (0, 1)]).collect()
    assert sorted(r.id for r in got) == [1, 2, 3]
