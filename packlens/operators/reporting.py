"""Dashboard, lists, search, paging and the flat sheet over scan tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import vocab


def verdict_counts(scans: DataFrame) -> DataFrame:
    """One row: total and a count for each known verdict, other verdicts only in the total."""
    return scans.agg(F.count("*").alias("total"), *[F.count_if(F.col("verdict") == v).alias(v) for v in vocab.VERDICTS])


def pass_rate(scans: DataFrame) -> DataFrame:
    """compliant / total, 0 without scans, and the rounded percentage."""
    rate = F.when(F.col("total") > 0, F.col("compliant") / F.col("total")).otherwise(0.0)
    return verdict_counts(scans).select("total", rate.alias("pass_rate"), F.floor(rate * 100 + 0.5).cast("long").alias("pass_percent"))


def top_violations(results: DataFrame, n: int = 8) -> DataFrame:
    """Codes by number of failures, all scans counted; equal counts in order of code."""
    failed = results.where((F.col("status") == "fail") & F.col("code").isNotNull() & (F.col("code") != ""))
    return failed.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code").limit(n)


def scaled(counts: DataFrame) -> DataFrame:
    """A bar's length in percent of the longest; counts has a row for each bar."""
    most = counts.agg(F.greatest(F.max("n"), F.lit(1)).alias("n")).scalar()
    return counts.withColumn("percent", F.floor(F.col("n") / most * 100 + 0.5).cast("long"))


def recent(scans: DataFrame, n: int = 10) -> DataFrame:
    return scans.orderBy(F.desc("created_at"), "id").select("id", "product_name", "verdict", "score").limit(n)


def filtered(scans: DataFrame, verdict: str | None = None, category: str | None = None) -> DataFrame:
    """Equality on verdict and category; values that aren't known are ignored."""
    if verdict in vocab.VERDICTS:
        scans = scans.where(F.col("verdict") == verdict)
    if (category or "").lower() in vocab.CATEGORIES:
        scans = scans.where(F.col("category") == category.lower())
    return scans


def page_bounds(page: object = None, limit: object = None) -> tuple[int, int]:
    """(page from 1, limit of 1 to 100, 20 by default)."""

    def whole(x: object) -> int:
        try:
            return int(float(str(x)))
        except (ValueError, OverflowError):
            return 0

    return max(1, whole(page) or 1), min(100, max(1, whole(limit) or 20))


def page_of(scans: DataFrame, page: object = None, limit: object = None) -> DataFrame:
    page, limit = page_bounds(page, limit)
    rows = scans.orderBy(F.desc("created_at"), "id").offset((page - 1) * limit).limit(limit)
    return rows.select("id", "product_name", "category", "verdict", "score", "photo_count", "created_at", "officer_id")


def page_count(scans: DataFrame, limit: object = None) -> DataFrame:
    _, limit = page_bounds(1, limit)
    return scans.agg(F.count("*").alias("total")).select("total", F.greatest(F.lit(1), F.ceil(F.col("total") / limit)).cast("long").alias("pages"))


def with_rule(scans: DataFrame, results: DataFrame, code: str, status: str = "fail") -> DataFrame:
    """Scans that have the rule with the status."""
    hit = results.where((F.col("code") == code) & (F.col("status") == status)).select(F.col("scan_id").alias("id"))
    return scans.join(hit, "id", "left_semi")


def with_officer(scans: DataFrame, users: DataFrame) -> DataFrame:
    """Scans with the officer's name, email and role, null without one; never the password hash."""
    own = users.select(F.col("user_id").alias("officer_id"), "user_name", "email", "role")
    return scans.join(own, "officer_id", "left")


def officer_label(name: Column, fallback: Column) -> Column:
    return F.coalesce(name, fallback, F.lit("—"))


def device_search(scans: DataFrame, query: str, text: Sequence[str] = ("product_name", "verdict", "category")) -> DataFrame:
    """Scans with the trimmed, lower-cased query in one of the columns."""
    q = query.strip().lower()
    hit = F.lit(False)
    for c in text:
        hit = hit | F.lower(c).contains(q)
    return scans.where(hit) if q else scans


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, plural s cut."""
    words = F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", "")).otherwise(w)))


STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "with"]


def search_any_term(rows: DataFrame, query: str, text: Column) -> DataFrame:
    """Rows with any of the query's terms; words after '-' must not occur, "quoted" parts must."""
    phrases, rest = [], []
    for i, part in enumerate(query.split('"')):
        (phrases if i % 2 else rest).append(part)
    words = " ".join(rest).lower().split()
    cut = lambda w: w[:-1] if len(w) > 3 and w.endswith("s") else w
    wanted = [cut(w) for w in words if not w.startswith("-") and w not in STOP_WORDS]
    barred = [cut(w[1:]) for w in words if w.startswith("-") and len(w) > 1]
    found = terms(text)
    if wanted:
        rows = rows.where(F.arrays_overlap(found, F.array(*map(F.lit, wanted))))
    if barred:
        rows = rows.where(~F.arrays_overlap(found, F.array(*map(F.lit, barred))))
    for p in phrases:
        rows = rows.where(F.lower(text).contains(p.lower()))
    return rows


def absolute_url(url: Column, base: str) -> Column:
    """'' for none, http(s) as is, else the base without its last '/' and the path with one before it."""
    path = F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("/"), url))
    return F.when(url.isNull() | (url == ""), "").when(url.rlike("^(?i)https?://"), url).otherwise(F.concat(F.lit(base.removesuffix("/")), path))


def rule_summary(results: DataFrame) -> DataFrame:
    """A row a scan: counts by status and the failed and unverified codes in order of rules, joined by ';'."""
    codes = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("status") == s, F.struct("rule_seq", "code")))), lambda x: x["code"]), ";")
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("fail", "fail_count"), ("warning", "warning_count"), ("manualReview", "review_count"), ("unverified", "unverified_count"), ("pass", "pass_count"))]
    return results.groupBy("scan_id").agg(*counts, codes("fail").alias("failed_rule_codes"), codes("unverified").alias("unverified_rule_codes"))


def scores(results: DataFrame) -> DataFrame:
    """Score and verdict of each scan by its results."""
    s, lost = F.col("status"), F.col("severity")
    penalty = F.when(s == "fail", F.when(lost == "error", 15).otherwise(10)).when(s.isin("warning", "unverified"), 5).when(s == "manualReview", 3).otherwise(0)
    df = results.groupBy("scan_id").agg(F.sum(penalty).alias("lost"), F.max((s == "fail").cast("int")).alias("failed"), F.max(s.isin("warning", "manualReview", "unverified").cast("int")).alias("open"))
    verdict = F.when(F.col("failed") == 1, "nonCompliant").when(F.col("open") == 1, "needsReview").otherwise("compliant")
    return df.select("scan_id", F.greatest(F.lit(0), 100 - F.col("lost")).cast("long").alias("score"), verdict.alias("verdict"))


def sheet(scans: DataFrame, observed: DataFrame, summary: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """The flat sheet, SHEET's columns in order, one row a scan.

    observed has one observation a (scan_id, field) with value and a map data; values are given
    whatever their status. What a scan lacks is '', counts are 0 and a missing confidence is 0.00.
    """
    pivoted = observed.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "data")))).alias("f"))
    df = scans.withColumnRenamed("id", "scan_id").join(pivoted, "scan_id", "left").join(summary, "scan_id", "left")
    df = df.join(photos, "scan_id", "left") if photos is not None else df.withColumn("photo_paths", F.lit(""))
    text = F.col("ocr_text") if "ocr_text" in scans.columns else F.lit("")
    value = lambda name: F.try_element_at("f", F.lit(name))["value"]
    data = lambda name, key: F.try_element_at(F.try_element_at("f", F.lit(name))["data"], F.lit(key))
    columns = {
        "id": F.col("scan_id"), "product_name": F.col("product_name"), "category": F.col("category"), "scanned_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "verdict": F.col("verdict"), "score": F.col("score"), "photo_count": F.col("photo_count"), "mean_confidence": F.format_string("%.2f", F.coalesce("mean_confidence", F.lit(0.0))), "region_count": F.col("region_count"),
        "generic_name": value("genericName"), "brand": value("brand"), "net_qty_raw": value("netQty"), "net_qty_value": data("netQty", "value"), "net_qty_unit": data("netQty", "unit"),
        "mrp_raw": value("mrp"), "mrp_value": data("mrp", "value"), "mrp_tax_phrase": F.when(text.rlike(r"(?i)inclusive\s+of\s+all\s+taxes?"), "yes").otherwise("no"),
        "mfg_raw": value("mfg"), "exp_raw": value("exp"), "manufacturer_name": value("manufacturer"), "manufacturer_address": data("manufacturer", "address"),
        "care_phone": value("carePhone"), "care_email": value("careEmail"), "country_of_origin": value("origin"), "batch_no": value("batch"), "fssai_lic": value("fssai"),
        "fail_count": F.coalesce("fail_count", F.lit(0)), "warning_count": F.coalesce("warning_count", F.lit(0)), "review_count": F.coalesce("review_count", F.lit(0)),
        "failed_rule_codes": F.coalesce("failed_rule_codes", F.lit("")), "photo_paths": F.coalesce("photo_paths", F.lit("")), "unverified_rule_codes": F.coalesce("unverified_rule_codes", F.lit("")),
    }
    return df.select(*[F.coalesce(columns[c].cast("string"), F.lit("")).alias(c) for c in vocab.SHEET])


def csv_cell(value: Column) -> Column:
    """A value as a cell: in quotes, its own doubled, where it holds a comma, a quote or a line end; '' for null."""
    value = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(value.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def csv_lines(sheet: DataFrame) -> DataFrame:
    """`line`: a row's cells with commas between them."""
    return sheet.select(F.concat_ws(",", *[csv_cell(F.col(c)) for c in sheet.columns]).alias("line"))


def write_csv(sheet: DataFrame, path: str) -> None:
    """One text file of csv_lines under the header, a line end after the last: for sheets that a person opens.

    A sheet is cut to the export's limit first; larger tables are better written as Parquet or by
    csv_lines and a text writer, a file a partition. An empty sheet is refused.
    """
    if sheet.isEmpty():
        raise ValueError("no scans to export")
    cells = [F.lit(c).alias(c) for c in sheet.columns]
    header = csv_lines(sheet.sparkSession.range(1).select(*cells))
    header.unionByName(csv_lines(sheet)).coalesce(1).write.text(path)


def export_name(product_name: Column, scan_id: Column) -> Column:
    """File name of a single scan's sheet: the product's letters, digits, '_' and '-' in lower case, words joined by '_'."""
    kept = F.trim(F.regexp_replace(F.coalesce(product_name, F.lit("")), r"[^A-Za-z0-9_\- ]+", ""))
    base = F.lower(F.regexp_replace(kept, " +", "_"))
    return F.concat(F.when(base == "", "product").otherwise(base), F.lit("_"), F.coalesce(scan_id.cast("string"), F.lit("scan")), F.lit(".csv"))


#: Lines of a scan's report and their order (fixed values): what a verdict is called, its meaning, and the declared fields.
VERDICT_LABELS = {"compliant": "COMPLIANT", "nonCompliant": "NON-COMPLIANT", None: "NEEDS REVIEW"}
VERDICT_COLOURS = {"compliant": "#1B5E20", "nonCompliant": "#C1272D", None: "#B7791F"}
HEADER = ("Legal Metrology (Packaged Commodities) Rules, 2011", "Compliance Inspection Report")
SEMANTICS = "Verdict semantics: FAIL = proven violation on an adequate capture. UNVERIFIED = capture too weak to prove absence — retake, don't penalise."
DECLARED = [
    ("Generic name", "genericName"), ("Brand", "brand"), ("Net quantity", "netQty"), ("MRP", "mrp"), ("Mfg / Pack date", "mfg"), ("Expiry / Best-before", "exp"), ("Manufacturer", "manufacturer"),
    ("Care phone", "carePhone"), ("Care email", "careEmail"), ("Country of origin", "origin"), ("Batch / lot", "batch"), ("FSSAI Lic. No.", "fssai"),
]
SIGNATURE = "Officer signature: ____________________________"
EVIDENCE_CUT, NONE = 140, "—"


def report_rows(scans: DataFrame, observed: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of each scan's report in order: scan_id, row_no, section, code, clause, text, colour.

    scans: id, product_name, category, verdict, score, created_at, photo_count, mean_confidence and, where
    there are such, officer_name, image_urls, checked_at. observed: one value a scan_id and field. results:
    scan_id, rule_seq, code, clause, status, message, evidence, photo_index. What is missing or '' is a dash;
    evidence is cut to 140 characters. A scan's rows are made of one row, as long as its results and photos.
    """
    text = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NONE))
    maybe = lambda n, kind="string": F.col(n) if n in scans.columns else F.lit(None).cast(kind)
    number = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    values = observed.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("__values"))
    order = F.struct("rule_seq", "code", "status", "message", "evidence", "photo_index", "clause")
    found = results.groupBy("scan_id").agg(F.sort_array(F.collect_list(order)).alias("__results"))
    df = scans.withColumnRenamed("id", "scan_id").join(values, "scan_id", "left").join(found, "scan_id", "left")
    blank = F.lit(None).cast("string")
    row = lambda section, t, code=blank, clause=blank, colour=blank: F.struct(F.lit(section).alias("section"), code.alias("code"), clause.alias("clause"), t.alias("text"), colour.alias("colour"))
    of_verdict = lambda named: F.when(F.col("verdict") == "compliant", named["compliant"]).when(F.col("verdict") == "nonCompliant", named["nonCompliant"]).otherwise(named[None])
    header = [
        *map(F.lit, HEADER),
        F.concat(F.lit("Product: "), F.coalesce("product_name", F.lit("")), F.lit("   |   Category: "), F.coalesce("category", F.lit(""))),
        F.concat(F.lit("Officer: "), text(maybe("officer_name")), F.lit("   |   Date: "), F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.lit(NONE))),
        F.concat(F.lit("Scan ID: "), F.col("scan_id").cast("string"), F.lit("   |   Photos: "), F.coalesce(F.col("photo_count").cast("string"), F.lit("0"))),
    ]
    verdict = F.concat(of_verdict(VERDICT_LABELS), F.lit("  •  Score "), number(F.col("score")), F.lit("/100"))
    declared = [F.concat(F.lit(f"{label}: "), text(F.try_element_at("__values", F.lit(field)))) for label, field in DECLARED]

    def finding(r: Column) -> Column:
        evidence = F.when(F.coalesce(r["evidence"], F.lit("")) != "", F.concat(F.lit(" ["), F.substring(r["evidence"], 1, EVIDENCE_CUT), F.lit("]"))).otherwise("")
        photo = F.when(r["photo_index"].isNotNull(), F.concat(F.lit(" (photo "), (r["photo_index"] + 1).cast("string"), F.lit(")"))).otherwise("")
        said = F.concat(F.upper(F.coalesce(r["status"], F.lit(""))), F.lit(" — "), F.coalesce(r["message"], F.lit("")), evidence, photo)
        return row("findings", said, F.coalesce(r["code"], F.lit("")), F.coalesce(r["clause"], F.lit("")))

    urls = F.coalesce(maybe("image_urls", "array<string>"), F.array().cast("array<string>"))
    photos = F.when(F.size(urls) == 0, F.array(row("photos", F.lit("No photo URLs stored.")))).otherwise(F.transform(urls, lambda u, i: row("photos", F.concat(F.lit("Photo "), (i + 1).cast("string"), F.lit(": "), F.coalesce(u, F.lit(""))))))
    generated = F.concat(F.lit("Generated by the compliance server • reportJson checkedAt: "), text(maybe("checked_at")), F.lit(" • meanConfidence: "), F.coalesce(number(F.col("mean_confidence")), F.lit(NONE)))
    parts = [
        F.array(*[row("header", t) for t in header], row("verdict", verdict, colour=of_verdict(VERDICT_COLOURS)), row("verdict", F.lit(SEMANTICS)), row("declared", F.lit("Declared values (as extracted on device)")), *[row("declared", t) for t in declared]),
        F.array(row("findings", F.lit("Rule findings")), row("findings", F.lit("Status / evidence"), F.lit("Code"), F.lit("Clause"))),
        F.transform(F.coalesce("__results", F.expr("array()").cast(found.schema["__results"].dataType)), finding),
        F.array(row("photos", F.lit("Photo evidence (reference URLs)"))),
        photos,
        F.array(row("signature", F.lit(SIGNATURE)), row("signature", generated)),
    ]
    # a column of its own is compiled: within the explode, the functions of arrays would have all of it interpreted;
    # outer, as a plain explode has Spark make the rows once more to filter by their number, and each scan has some
    df = df.select("scan_id", F.concat(*parts).alias("rows"))
    return df.select("scan_id", F.posexplode_outer("rows").alias("row_no", "r")).select("scan_id", "row_no", "r.*")
