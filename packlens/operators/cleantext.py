"""Clean text of a photo's recognised regions: kept regions in reading order, lines with glued fragments, fixed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions import text as T
from packlens.operators import layout

KEYS = layout.KEYS
NUMERIC, SHORT = r"^[\d.,%]+$", "^[A-Za-z0-9%]+$"


def reading_order(regions: DataFrame) -> DataFrame:
    """Kept regions, a row each, with pos (from 0 in a photo) and line_no.

    regions: scan_id, photo, token_id, text, conf, x1, y1, x2, y2. Regions are put on lines by first
    fit from top to bottom, lines go by their mean centre and regions by their left edge. A sweep over
    that order then begins a new line wherever a centre is off the mean of the line so far. Ties go by
    token_id. Null texts and specks are left out; a photo's regions are gathered, which a photo bounds.
    """
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kept = regions.where(T.keep_token(F.col("text"), width, height, F.col("conf")))
    item = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("cy"), "token_id", "x1", "x2", height.alias("h"), "text", "conf")
    df = kept.groupBy(*KEYS).agg(F.sort_array(F.collect_list(item)).alias("ts"))
    med = F.element_at(F.sort_array(F.transform("ts", lambda t: t["h"])), (F.floor(F.size("ts") / 2) + 1).cast("int"))
    df = df.withColumn("tol", F.greatest(F.least(F.greatest(med, F.lit(8.0)), F.lit(80.0)) * 0.6, F.lit(8.0)))
    df = df.withColumn("a", layout.first_fit("ts", F.col("tol")))
    placed = F.transform("ts", lambda t, i: F.struct(F.get(F.col("a.means"), F.get(F.col("a.at"), i))["cy"].alias("line_cy"), F.get(F.col("a.at"), i).alias("line"), t["x1"].alias("x1"), t["token_id"].alias("token_id"), t.alias("t")))
    df = df.select(*KEYS, "tol", F.sort_array(placed).alias("ps"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, p: Column) -> Column:
        cy = p["t"]["cy"]
        same = (a["n"] == 0) | (F.abs(cy - a["sum"] / a["n"]) < F.col("tol"))
        line = F.coalesce(F.get(a["at"], F.size(a["at"]) - 1), F.lit(0))
        at = F.array_append(a["at"], F.when(same, line).otherwise(line + 1))
        return F.struct(F.when(same, a["sum"] + cy).otherwise(cy).alias("sum"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), at.alias("at"))

    df = df.withColumn("at", F.aggregate("ps", zero, step)["at"])
    rows = df.select(*KEYS, F.posexplode(F.arrays_zip("ps", "at")).alias("pos", "z"))
    return rows.select(*KEYS, "pos", F.col("z.at").alias("line_no"), "z.ps.t.token_id", "z.ps.t.text", "z.ps.t.conf", "z.ps.t.x1", "z.ps.t.x2")


def joined_lines(ordered: DataFrame, lexicon: bool = True) -> DataFrame:
    """(keys, line_no, text): cleaned regions joined, of doubled detections the surer one, digits and pieces with hardly a gap glued."""
    df = ordered.withColumn("t", T.clean_token(F.col("text"))).where((F.col("t") != "") & ~F.col("t").rlike(T.PUNCTUATION))
    item = F.struct("x1", "pos", "x2", "conf", "t")
    df = df.groupBy(*KEYS, "line_no").agg(F.sort_array(F.collect_list(item)).alias("ts"))

    def step(a: Column, t: Column) -> Column:
        last = F.get(a, F.size(a) - 1)
        narrow = F.least(last["x2"] - last["x1"], t["x2"] - t["x1"])
        shared = F.greatest(F.lit(0.0), F.least(last["x2"], t["x2"]) - F.greatest(last["x1"], t["x1"]))
        double = F.coalesce((F.lower(last["t"]) == F.lower(t["t"])) & (narrow > 0) & (shared > narrow * 0.5), F.lit(False))
        surer = F.concat(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), F.array(t))
        return F.when(~double, F.array_append(a, t)).when(t["conf"] > last["conf"], surer).otherwise(a)

    df = df.withColumn("us", F.aggregate("ts", F.slice("ts", 1, 0), step))

    def piece(t: Column, i: Column) -> Column:
        b = F.get(F.col("us"), i - 1)
        char = F.greatest((b["x2"] - b["x1"]) / F.length(b["t"]), (t["x2"] - t["x1"]) / F.length(t["t"]), F.lit(4.0))
        digits = b["t"].rlike(NUMERIC) & t["t"].rlike(NUMERIC)
        bits = (F.length(b["t"]) <= 2) & (F.length(t["t"]) <= 2) & F.concat(b["t"], t["t"]).rlike(SHORT)
        glued = (t["x1"] - b["x2"] < char * 0.45) & (digits | bits)
        return F.when((i == 0) | F.coalesce(glued, F.lit(False)), t["t"]).otherwise(F.concat(F.lit(" "), t["t"]))

    line = F.array_join(F.transform("us", piece), "")
    return df.select(*KEYS, "line_no", T.fixed_line(line, lexicon).alias("text"))


def clean_text(regions: DataFrame, lexicon: bool = True) -> DataFrame:
    """(scan_id, photo, text): a photo's lines, words that a hyphen wrapped put together; photos without a kept region have no row."""
    lines = T.unwrapped(joined_lines(reading_order(regions), lexicon), *KEYS)
    gathered = lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    return gathered.select(*KEYS, F.trim(F.array_join(F.transform("ls", lambda x: x["text"]), "\n")).alias("text"))


def mean_confidence(regions: DataFrame, kept: DataFrame) -> DataFrame:
    """(scan_id, photo, mean_confidence) of every photo of regions, over its rows in kept; 0 where there is none."""
    # both grow with the regions, which Spark's estimate takes for few where they are exploded
    means = kept.groupBy(*KEYS).agg(F.avg("conf").alias("mean")).hint("merge")
    return regions.select(*KEYS).distinct().join(means, KEYS, "left").select(*KEYS, F.coalesce("mean", F.lit(0.0)).alias("mean_confidence"))
