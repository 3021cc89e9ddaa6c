"""What rules say in words: message, evidence, photo and action of each result, one row a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packlens.functions import vocab
from packlens.operators import rules

#: Columns of observations that are shown where they are there.
SHOWN = {"label": "string", "evidence": "string", "photo_index": "int", "note": "string", "relationship": "string"}
#: Rules whose evidence names the label, and those whose observation's note replaces the message.
LABELLED = ["LM-R6-NETQ", "LM-R6-MRP", "LM-R6-BATCH", "LM-R6-DATE-MFG", "LM-R6-DATE-EXP"]
NOTED = ["LM-R6-MRP", "LM-R6-BATCH", "LM-R6-DATE-MFG", "LM-R6-DATE-EXP"]


def sayings(scans: DataFrame) -> DataFrame:
    """The fixed table of messages, with title, clause and field: a row a (code, kind)."""
    about = {code: (title, clause, *vocab.RESULT_FIELDS[code]) for code, title, clause, _ in vocab.RULES}

    def message(code: str, kind: str, text: str) -> str:
        if kind != "weak":
            return text
        return vocab.WEAK.replace("{}", text) + ("" if "DATE" in code else vocab.WEAK_TAIL) + "."

    rows = [(code, kind, message(code, kind, text), panel and vocab.ACTION.replace("{}", panel), *about[code]) for code, kind, text, panel in vocab.FINDINGS]
    return scans.sparkSession.createDataFrame(rows, "code string, kind string, template string, action string, title string, clause string, result_field string, subject string")


def findings(scans: DataFrame, observed: DataFrame, font_review: bool = True) -> DataFrame:
    """(id, rule_seq, code, title, clause, field, status, severity, message, evidence, photo_index, action) of each rule that applies.

    scans and observed as in `rules.evaluated`; observed may have label, evidence, photo_index, note and
    relationship (`variable_crop`: read a second time). Evidence that isn't there is null, or empty after its label.
    """
    df = observed.withColumns({c: (F.col(c) if c in observed.columns else F.lit(None)).cast(t) for c, t in SHOWN.items()})
    df = rules.evaluated(scans, df, font_review, tuple(SHOWN))
    df = rules.exploded(df, "id", "mean_confidence", "ocr_text", "fields").select("*", "r.*")
    of = lambda f: F.try_element_at("fields", F.lit(f))
    code, status = F.col("code"), F.col("status")
    phone, email = of("carePhone"), of("careEmail")
    has = lambda o: F.coalesce(o["status"] == "found", F.lit(False))
    partial = (code == "LM-R6-CARE") & (status == "unverified") & (has(phone) | has(email))
    unclear = F.when(F.col("severity") == "error", "weak").when(partial, "partial").otherwise("glimpsed")
    kind = F.when(status == "pass", "found").when(status == "fail", "absent").when(status == "warning", "warned").when(status == "manualReview", "review").otherwise(unclear)
    # a table of fixed size
    df = df.withColumn("kind", kind).join(F.broadcast(sayings(scans)), ["code", "kind"], "left")

    o = F.try_element_at("fields", F.col("subject"))
    kind, blank = F.col("kind"), F.lit("")
    again = F.when(o["relationship"] == "variable_crop", vocab.READ_AGAIN).otherwise(blank)
    mrp, role = of("mrp"), F.coalesce(F.try_element_at(of("manufacturer")["data"], F.lit("role")), F.lit("manufacturer"))
    number = F.try_element_at(mrp["data"], F.lit("value")).try_cast("double")
    price = F.coalesce(F.when(number % 1 == 0, F.format_string("%.0f", number)).when(number.isNotNull(), F.format_string("%.2f", number)), mrp["value"], blank)
    mentions = F.regexp_count(F.coalesce("ocr_text", blank), F.lit(rules.MENTION)).cast("string")
    filled = (
        F.when(code == "LM-R6-NAME", F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30)))
        .when(code == "LM-R6-COMMON", o["value"])
        .when(code == "LM-R6-MRP", F.concat(price, F.lit(" detected"), again))
        .when(code == "LM-R9-SINGLE-MRP", mentions)
        .when(code == "LM-R6-CARE", F.when(has(phone), "phone").otherwise("email"))
        .when(code == "LM-READ-QUALITY", F.format_string("%.0f", F.col("mean_confidence") * 100))
        .otherwise(again)
    )
    note = F.when(code.isin(NOTED) & (kind == "glimpsed"), o["note"])
    message = F.coalesce(note, F.replace("template", F.lit("{}"), F.coalesce(filled, blank)))
    shown = o["status"].isin("found", "unverified") & kind.isin("found", "glimpsed", "warned", "partial")
    evidence = (
        F.when(code == "LM-R9-SINGLE-MRP", F.concat(F.lit("Mentions: "), mentions))
        .when((code == "LM-READ-QUALITY") & (kind == "glimpsed"), F.format_string("meanConfidence=%.2f", F.col("mean_confidence")))
        .when((code == "LM-R6-CARE") & (kind == "found"), F.concat_ws(" • ", phone["value"], email["value"]))
        .when((code == "LM-R6-CARE") & kind.isin("partial", "glimpsed", "warned"), F.coalesce(phone["evidence"], email["evidence"]))
        .when(shown & (kind == "found") & code.isin(LABELLED), F.concat(F.coalesce(F.concat(o["label"], F.lit(": ")), blank), F.coalesce(o["evidence"], blank)))
        .when(shown, o["evidence"])
    )
    return df.select("id", "rule_seq", "code", "title", "clause", F.col("result_field").alias("field"), "status", "severity", message.alias("message"), evidence.alias("evidence"), F.when(shown, o["photo_index"]).alias("photo_index"), "action")
