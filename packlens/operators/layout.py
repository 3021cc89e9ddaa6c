"""Tokens to lines and blocks, as column expressions over each photo's tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions import text as T

KEYS = ["scan_id", "photo"]


def first_fit(items: str, tol: Column) -> Column:
    """means (cy, n) of lines and `at`, each item's line: the first one whose running mean of cy is within tol, or a new one."""
    zero = F.struct(F.array().cast("array<struct<cy:double,n:int>>").alias("means"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, t: Column) -> Column:
        near = F.array_position(F.transform(a["means"], lambda m: F.abs(t["cy"] - m["cy"]) < tol), F.lit(True)).cast("int")
        means = F.transform(a["means"], lambda m, i: F.when(i + 1 == near, F.struct(((m["cy"] * m["n"] + t["cy"]) / (m["n"] + 1)).alias("cy"), (m["n"] + 1).alias("n"))).otherwise(m))
        grown = F.array_append(a["means"], F.struct(t["cy"].alias("cy"), F.lit(1).alias("n")))
        return F.when(near > 0, F.struct(means.alias("means"), F.array_append(a["at"], near - 1).alias("at"))).otherwise(F.struct(grown.alias("means"), F.array_append(a["at"], F.size(a["means"])).alias("at")))

    return F.aggregate(items, zero, step)


def runs(items: str, tol: Column) -> Column:
    """first_fit of items that rise by cy, as the first place of each line.

    All of a line's items lie tol or more above those that began a later one, so that only the last line can take the next item.
    """
    none = F.lit(None).cast("double")
    zero = F.struct(none.alias("cy"), F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("firsts"))

    def step(a: Column, t: Column) -> Column:
        near = F.coalesce((a["n"] > 0) & (F.abs(t["cy"] - a["cy"]) < tol), F.lit(False))
        return F.struct(
            F.when(near, (a["cy"] * a["n"] + t["cy"]) / (a["n"] + 1)).otherwise(t["cy"]).alias("cy"), F.when(near, a["n"] + 1).otherwise(1).alias("n"),
            (a["i"] + 1).alias("i"), F.when(near, a["firsts"]).otherwise(F.array_append(a["firsts"], a["i"])).alias("firsts"),
        )

    return F.aggregate(items, zero, step, lambda a: a["firsts"])


def lines(tokens: DataFrame) -> DataFrame:
    """One row a line: line_no, text, conf, box, cy, top and height (shares), med (of heights) and members.

    tokens: scan_id, photo, token_id, text, conf, x1, y1, x2, y2, img_w, img_h. From top to bottom each
    token joins the first line whose running mean centre is within the tolerance, or begins one. A
    photo's tokens are gathered, which a photo bounds; its lines are made within its row.
    """
    speck = ((F.col("x2") - F.col("x1") < 6) | (F.col("y2") - F.col("y1") < 6)) & F.trim("text").rlike(T.PUNCTUATION)
    df = tokens.where((F.trim("text") != "") & ~speck & (F.col("img_w") > 0) & (F.col("img_h") > 0))
    token = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("cy"), "x1", "token_id", "text", "conf", "y1", "x2", "y2")
    df = df.groupBy(*KEYS).agg(F.sort_array(F.collect_list(token)).alias("ts"), F.max("img_h").alias("img_h"), F.max("img_w").alias("img_w"))
    heights = F.sort_array(F.transform("ts", lambda t: t["y2"] - t["y1"]))
    med = F.least(F.greatest(F.element_at(heights, (F.floor(F.size("ts") / 2) + 1).cast("int")), F.lit(8.0)), F.lit(80.0))
    df = df.withColumn("med", med).withColumn("tol", F.greatest(F.lit(8.0), F.least(F.col("med") * 0.6, F.col("img_h") * 0.05)))
    # lines rise by their mean centres as they are begun
    cut = lambda at: F.transform(at, lambda i, j: F.slice("ts", i + 1, F.coalesce(F.get(at, j + 1), F.size("ts")) - i))
    out = df.select(*KEYS, "img_h", "img_w", "med", F.posexplode(T.bound([runs("ts", F.col("tol"))], cut)).alias("line_no", "ls"))
    members = F.sort_array(F.transform("ls", lambda t: F.struct(t["x1"].alias("x1"), t["token_id"].alias("token_id"), t["text"].alias("text"))))
    text = F.array_join(F.array_remove(F.transform(members, lambda m: F.trim(m["text"])), ""), " ")
    known = F.filter(F.transform("ls", lambda t: t["conf"].cast("double")), lambda c: c.isNotNull())
    mean = T.bound([known], lambda cs: F.when(F.size(cs) > 0, F.aggregate(cs, F.lit(0.0), lambda a, c: a + c) / F.size(cs)))
    of = lambda n: F.transform("ls", lambda t: t[n])
    out = out.select(*KEYS, "line_no", text.alias("text"), mean.alias("conf"), F.array_min(of("x1")).alias("x1"), F.array_min(of("y1")).alias("y1"), F.array_max(of("x2")).alias("x2"), F.array_max(of("y2")).alias("y2"), "img_w", "img_h", "med")
    return out.select(
        *out.columns,
        ((F.col("y1") + F.col("y2")) / 2 / F.col("img_h")).alias("cy"),
        (F.col("y1") / F.col("img_h")).alias("top"),
        ((F.col("y2") - F.col("y1")) / F.col("img_h")).alias("height"),
    )


def blocks(lines: DataFrame) -> DataFrame:
    """Lines with block_no: a new block begins after a wide gap or below a line that hardly overlaps it."""
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    x1, x2, y2 = (F.lag(c).over(w) for c in ("x1", "x2", "y2"))
    gap = F.col("y1") - y2
    limit = F.greatest(F.lit(10.0), F.least(F.col("med") * 1.6, F.col("img_h") * 0.08))
    shared = F.greatest(F.lit(0.0), F.least(F.col("x2"), x2) - F.greatest(F.col("x1"), x1))
    narrow = F.least(F.col("x2") - F.col("x1"), x2 - x1)
    overlap = F.when(narrow > 0, shared / narrow).otherwise(0.0)
    new = F.when(x1.isNull(), 0).when((gap > limit) | (overlap <= 0.15), 1).otherwise(0)
    return lines.withColumn("__new", new).withColumn("block_no", F.sum("__new").over(w).cast("int")).drop("__new")


def hints(blocked: DataFrame) -> DataFrame:
    """(keys, block_no, hint): what a block seems to be about."""
    df = blocked.groupBy(*KEYS, "block_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"), F.min_by("top", "line_no").alias("top"))
    text = F.lower(F.array_join(F.transform("ls", lambda x: x["text"]), "\n"))
    hint = (
        F.when(text.rlike("ingred"), "ingredients").when(text.rlike("nutrition|per 100 ?g|kcal|protein"), "nutrition")
        .when(text.rlike("manufactured|marketed|packed|imported|mfd |mkt |brand owned"), "manufacturer")
        .when(text.rlike("consumer care|customer care|complaint|helpline|toll free|customercare"), "consumerCare")
        .when(text.rlike("batch|lot no|date of mfg|use by|best before|(?<![A-Za-z0-9_])mrp(?![A-Za-z0-9_])|maximum retail"), "variable")
        .when(text.rlike(r"^\s*[\d ]{8,}\s*$") & (F.size("ls") <= 2), "barcode").when(F.col("top") < 0.35, "identity").otherwise("unknown")
    )
    return df.select(*KEYS, "block_no", hint.alias("hint"))


def edited(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines with an officer's texts (scan_id, photo, line_no, edit); boxes and confidences stay."""
    return lines.join(edits, [*KEYS, "line_no"], "left").withColumn("text", F.coalesce("edit", "text")).drop("edit")


def combined_text(lines: DataFrame) -> DataFrame:
    """(scan_id, combined_text): blocks' lines, a section for each photo where there are several."""
    block = lines.groupBy(*KEYS, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))
    photo = block.groupBy(*KEYS).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    all_photos = photo.groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("photo", "text"))).alias("ps"))
    section = F.transform("ps", lambda p, i: F.concat(F.lit("===== PHOTO "), (i + 1).cast("string"), F.lit(" =====\n"), p["text"]))
    return all_photos.select("scan_id", F.when(F.size("ps") == 1, F.col("ps")[0]["text"]).otherwise(F.array_join(section, "\n\n")).alias("combined_text"))
