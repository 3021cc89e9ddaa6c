"""Work that grew too fast with the tables: what it gives, and that the plan has less of it."""

import pyarrow as pa
from pyspark.sql import functions as F

from packlens.functions import grams
from packlens.operators import classify, layout
from packlens.plans import register

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_counted_where_the_line_is(spark):
    """An aggregate over the n-grams of all lines took the time."""
    assert "gram#" not in " ".join(x for x in plan(register.QUERIES["ngram_features"](spark, DATA)).split("\n") if "Aggregate" in x)
    rows = [(1, "aaaa  b\U0001f600c\t Émile"), (1, "AAA"), (2, ""), (3, None), (4, "  ")]
    lines = spark.createDataFrame(rows, "id int, text string")
    want = lines.select("id", F.explode(classify.ngrams(F.col("text"))).alias("gram")).groupBy("id", "gram").count()
    got = classify.counted(lines, "id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == ["id", "gram", "n"]


def test_ngrams_of_large_alphabets():
    """A number of 63 bits doesn't hold every n-gram: texts are halved, one alone is counted plainly."""
    odd = " " + "".join(map(chr, range(0x4E00, 0x4E00 + 9000))) + " "
    got = {(int(r), g): int(n) for row, gs, ns in grams.counts(pa.array([" ab ", odd, " ab ab "]), 3, 5) for r, g, n in zip(row, gs.to_pylist(), ns, strict=True)}
    assert got[0, " ab"] == 1 and got[2, " ab"] == 2 and got[2, " ab "] == 2 and sum(r == 1 for r, _ in got) == 3 * 9002 - 2 - 3 - 4


def test_lines_are_made_within_a_photo(spark):
    """Each line was gathered again from the rows of its tokens, and numbered by a window; each token was held against every line."""
    shown = plan(register.QUERIES["line_cluster"](spark, DATA))
    assert "Window" not in shown and shown.count("Aggregate") == 2, shown
    box = "scan_id int, photo int, token_id int, text string, conf double, x1 double, y1 double, x2 double, y2 double, img_w double, img_h double"
    at = [0.0, 5.0, 11.0, 13.0, 14.5, 40.0, 47.0, float("nan")]
    rows = [(1, 0, i, f"t{i}", None if i > 4 else 0.1 * i, 10.0 * i, y, 10.0 * i + 8, y + 10, 500.0, 500.0) for i, y in enumerate(at)]
    got = layout.lines(spark.createDataFrame(rows, box)).orderBy("line_no").collect()
    ts = spark.createDataFrame([(sorted((True, y, y) for y in at if y == y),)], "t array<struct<a:boolean,b:double,cy:double>>")
    firsts, lines = ts.select(layout.runs("t", F.lit(8.0)), layout.first_fit("t", F.lit(8.0))["at"]).first()
    assert firsts == [lines.index(k) for k in range(max(lines) + 1)] == [0, 2, 5]
    assert [r.text for r in got] == ["t0 t1", "t2 t3 t4", "t5 t6", "t7"] and [r.line_no for r in got] == [0, 1, 2, 3]
    assert got[1].conf == (0.0 + 0.2 + 0.1 * 3 + 0.4) / 3 and got[2].conf is None and (got[1].y1, got[1].y2) == (11.0, 24.5)


def test_photos_are_read_once(spark):
    """Outcomes joined four aggregates, and lines the photos' sizes, to the regions."""
    for name in ("photo_outcomes", "photo_lines"):
        assert "Join" not in plan(register.QUERIES[name](spark, DATA))


def test_reasons_and_results_are_computed_once(spark):
    """Each was computed again for every use of it, and once more to filter by how many there are."""
    said = lambda name: register.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert said("product_constraints").count("\\p{Z}") <= 14  # twice in each of the patterns
    for name in ("rules_from_observations", "rule_findings"):
        assert said(name).count("rule_seq, 0, code, LM-R6-NAME") == 1
