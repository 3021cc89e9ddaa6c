"""Labelled fields: lines are held against a label's patterns only where its first letters come, and values are read in compiled columns."""

from packlens.functions import labels as L
from packlens.operators import extract
from packlens.plans import register

DATA = "/root/testdata/sf0.001"
LINE = "scan_id long, photo int, line_no int, block_no int, text string, conf double, cy double, top double"
TEXTS = [
    "Net", "wt. 12,5 GMS", "NET", "net", "WEIGHT: 3 kg", " nEt ", "Qty 7 pcs", "no NET", "net qty 0 g", "Per 100 g net weight 3 g", "Kode 5", "DATE  OF MFG. 3 / 4 / 21 (1/1/01)", "Packed on 31-12-1989",
    "pkd. date\t05.06.49 x", "MFD", "12 march, 2024", "USE\xa0BY", "use by 1 may 2020 2/2/2022", "EXPIRATION 07/08/123", "exp. 07-08-22", "best\nbefore (2/2/22", None, "", "B.No. AB-12", "code X9", "m. r. p. 5", "Date of expiry May 2031",
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def photos(spark):
    rows = [(s, s % 2, i, i // 3 if i % 7 else None, t, 0.8, i * 0.04, 0.1) for s in range(8) for i, t in enumerate(TEXTS[s:] + TEXTS[:s])]
    return spark.createDataFrame(rows, LINE)


def test_a_label_begins_with_its_stem(spark, monkeypatch):
    assert L.stem(r"mktd?\s*by") == "mkt" and L.stem(r"\bb\.?\s*no") == "b" and L.stem(r"(a|b)c") == "" and L.stem(r"a?b") == ""
    lines = photos(spark)
    every = lambda: sorted(map(str, extract.product(lines).collect()))
    got = every()
    monkeypatch.setattr(L, "stem", lambda pattern: "")
    assert got == every() and {"netQty", "mfg", "exp", "batch", "mrp"} <= {x for x in L.LABELS if f"field='{x}'" in " ".join(got)}


def test_dates_and_quantities_are_read_in_compiled_columns(spark):
    """An array's function, of which dates and quantities were, is interpreted for each attempt."""
    for name, of in (("extract_mfg_date", "jan(?:uary)?"), ("extract_exp_date", "jan(?:uary)?"), ("extract_net_qty", "kilograms?")):
        at = [x for x in plan(register.QUERIES[name](spark, DATA)).split("\n") if of in x]
        assert at and not any("lambda" in x for x in at)


def test_dates(spark):
    day = lambda *texts: [(r.scan_id, r.value, r.status) for r in extract.date(spark.createDataFrame([(i, 0, 0, 0, t, 0.9, 0.1, 0.1) for i, t in enumerate(texts)], LINE), "mfg").orderBy("scan_id").collect()]
    got = day("Mfg date 3/4/21", "Mfg date 3 * / * 4/2046", "mfg date 3/4/50 (4/4/21)", "mfg date (4/4/21)", "MFG DATE: Sept, 2024", "mfg date 31.12.1990x", "mfg date 32/13/20", None)
    assert got == [(0, "3/4/21", "found"), (1, None, "unverified"), (2, None, "unverified"), (3, None, "unverified"), (4, "Sept 2024", "found"), (5, None, "unverified"), (6, None, "unverified")]


def test_net_over_two_lines_needs_no_sort_of_all_lines(spark):
    assert "lag(" not in plan(register.QUERIES["extract_net_qty"](spark, DATA))
    rows = [(0, "Net", 1), (1, "between", 2), (2, "Weight 5 g", 1), (3, "far", 3)]
    lines = spark.createDataFrame([(1, 0, n, b, t, 0.9, n * 1.0, 0.1) for n, t, b in rows] + [(2, 0, 0, None, " NET ", 0.9, 0.1, 0.1), (2, 0, 1, None, "7 kg", 0.9, 0.12, 0.1)], LINE)
    got = {r.scan_id: (r.number, r.unit, r.label) for r in extract.net_quantity(lines).collect()}
    assert got == {1: (5.0, "g", "NET Weight 5 g"), 2: (7.0, "kg", "NET")}


def test_report_rows_are_made_once_in_a_compiled_column(spark):
    """Within the explode they were interpreted; a plain explode of the column makes them again to filter by their number."""
    lines = plan(register.QUERIES["scan_report_rows"](spark, DATA)).split("\n")
    made = [x for x in lines if "Rule findings" in x]
    assert made and all("Project" in x for x in made)
