"""Field extraction from label lines.

lines: scan_id, photo, line_no, block_no, text, conf (0..1), cy and top (centre and top, as shares of
the image's height), optionally height, vote_class and vote_prob. Each extractor gives at most one
observation a photo: scan_id, photo, field, status, value, number, unit, confidence, label, relationship.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packlens.functions import labels as L
from packlens.functions.text import bound
from packlens.operators.merge import UNITS

KEYS = ["scan_id", "photo"]
OUT = [*KEYS, "field", "status", "value", "number", "unit", "confidence", "label", "relationship"]


def blend(strength: Column, conf: Column) -> Column:
    """Confidence of a match: its strength weakened by the reader's confidence, to two places."""
    return F.floor(strength * (0.55 + 0.45 * F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))) * 100 + 0.5) / 100


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.70, "found").when(confidence >= 0.45, "unverified").otherwise("notFound")


def with_votes(lines: DataFrame) -> DataFrame:
    for name, kind in (("vote_class", "string"), ("vote_prob", "double"), ("height", "double")):
        if name not in lines.columns:
            lines = lines.withColumn(name, F.lit(None).cast(kind))
    return lines


def may_have(text: Column, pattern: str) -> Column:
    """False where the text lacks the letters that the label's pattern begins with: a byte search, so that few texts are held against the pattern."""
    return F.lower(text).contains(L.stem(pattern))


def matches(text: Column, field: str) -> Column:
    return reduce(lambda a, b: a | b, [may_have(text, p) & text.rlike(L.java(p)) for p, _ in L.LABELS[field]])


def hits(lines: DataFrame, field: str) -> DataFrame:
    """Lines with a label of the field: the strongest pattern, the first of equals; a stronger vote takes the whole line."""
    found = [F.when(may_have(F.col("text"), p) & F.col("text").rlike(L.java(p)), F.struct(F.lit(s).alias("strength"), F.lit(-i).alias("order"), F.regexp_extract("text", L.java(p), 0).alias("label"))) for i, (p, s) in enumerate(L.LABELS[field])]
    df = with_votes(lines).withColumn("hit", F.array_max(F.array_compact(F.array(*found))))
    strength = F.coalesce(F.col("hit.strength"), F.lit(0.0))
    voted = F.coalesce((F.col("vote_class") == L.CLASSES[field]) & (F.col("vote_prob") >= L.VOTE_THRESHOLD) & (F.col("vote_prob") > strength), F.lit(False))
    df = df.withColumn("voted", voted).where(F.col("voted") | F.col("hit").isNotNull())
    return df.withColumn("strength", F.when(F.col("voted"), F.col("vote_prob")).otherwise(strength)).withColumn("label", F.when(F.col("voted"), F.col("text")).otherwise(F.col("hit.label"))).drop("hit")


def after_label(df: DataFrame) -> Column:
    """Text after the first place of the label, or of its last word where nothing follows; a voted line whole."""
    after = "case when locate(lower({0}), lower(text)) > 0 then substring(text, locate(lower({0}), lower(text)) + length({0})) else '' end"
    full = F.expr(after.format("label"))
    return F.when(F.col("voted"), F.col("text")).when(F.trim(full) != "", full).otherwise(F.expr(after.format("element_at(split(label, ' '), -1)")))


def hits_of(field: str) -> Column:
    """An array of the line's hit of the field (field, hit_seq, strength, label, voted), or of none; each pattern is read once."""
    patterns = L.LABELS[field]
    texts = F.array(*[F.when(may_have(F.col("text"), p), F.regexp_extract("text", L.java(p), 0)).otherwise("") for p, _ in patterns])
    strengths = F.array(*[F.lit(float(s)) for _, s in patterns])
    found = F.filter(F.transform(texts, lambda x, i: F.struct(F.get(strengths, i).alias("strength"), (-i).alias("order"), x.alias("label"))), lambda x: x["label"] != "")
    none = F.array().cast("array<struct<field:string,hit_seq:long,strength:double,label:string,voted:boolean>>")
    hit = lambda strength, label, voted: F.array(F.struct(F.lit(field).alias("field"), F.col("line_no").cast("long").alias("hit_seq"), strength.alias("strength"), label.alias("label"), voted.alias("voted")))

    def of(best: Column) -> Column:
        by_vote = F.coalesce((F.col("vote_class") == L.CLASSES[field]) & (F.col("vote_prob") >= L.VOTE_THRESHOLD) & (F.col("vote_prob") > F.coalesce(best["strength"], F.lit(0.0))), F.lit(False))
        return F.when(by_vote, hit(F.col("vote_prob"), F.col("text"), F.lit(True))).when(best.isNotNull(), hit(best["strength"], best["label"], F.lit(False))).otherwise(none)

    # functions of arrays are interpreted, so most lines are told apart before them
    voted = F.coalesce(F.col("vote_class") == L.CLASSES[field], F.lit(False))
    maybe = reduce(lambda a, b: a | b, [F.lower("text").contains(s) for s in dict.fromkeys(L.stem(p) for p, _ in patterns)])
    return F.when(voted | maybe, F.transform(F.array(F.array_max(found)), of)[0]).otherwise(none)


def after(label: Column, text: Column, voted: Column) -> Column:
    """after_label for columns of any name."""
    rest = lambda x: F.when(F.instr(F.lower(text), F.lower(x)) > 0, text.substr(F.instr(F.lower(text), F.lower(x)) + F.length(x), F.length(text))).otherwise("")
    return F.when(voted, text).when(F.trim(rest(label)) != "", rest(label)).otherwise(rest(F.element_at(F.split(label, " "), -1)))


def attempts(lines: DataFrame, net: bool = False) -> DataFrame:
    """Texts to read a value from for each hit in lines' `hits`: the rest of its line, then the photo's nearby lines.

    A photo's lines are gathered once, whatever the fields; a photo bounds them. With net, net_hits are among the hits.
    """
    item = ["line_no", "text", "conf", "cy", "hits"]
    if net:
        text = F.col("text")
        low = F.lower(text)
        lone = low.contains("net") & text.rlike(NET)
        wrap = reduce(lambda a, b: a | b, [low.contains(x) for x in ("weight", "wt", "qty", "quantity", "content")]) & text.rlike(NET_WRAP)
        lines = lines.withColumns({"__net": F.coalesce(lone, F.lit(False)), "__wrap": F.coalesce(wrap, F.lit(False))})
        item += ["block_no", "__net", "__wrap"]
    wanted = lambda x: (F.size(x["hits"]) > 0) | x["__net"] | x["__wrap"] if net else F.size(x["hits"]) > 0
    df = lines.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct(*item))).alias("ls")).where(F.exists("ls", wanted))
    df = df.withColumn("ls", net_hits(F.col("ls"))) if net else df

    def tried(h: Column, x: Column, seq: Column, prox: Column, relationship: Column, text: Column, conf: Column) -> Column:
        return F.struct(*[h[n].alias(n) for n in ("field", "hit_seq", "strength", "label")], x["text"].alias("label_text"), seq.cast("long").alias("attempt_seq"), prox.alias("prox"), relationship.alias("relationship"), text.alias("attempt"), conf.alias("ocr"))

    def of(x: Column, h: Column) -> Column:
        own = tried(h, x, F.lit(-1), F.lit(1.0), F.lit("same_line_right"), after(h["label"], x["text"], h["voted"]), x["conf"])
        row = lambda o: F.abs(o["cy"] - x["cy"]) < 0.03
        near = F.filter("ls", lambda o: (o["line_no"] != x["line_no"]) & (F.abs(o["cy"] - x["cy"]) < 0.07) & (F.trim(o["text"]) != ""))
        others = F.transform(near, lambda o: tried(h, x, o["line_no"], F.when(row(o), 0.95).otherwise(0.75), F.when(row(o), "same_row").otherwise("nearby"), o["text"], o["conf"]))
        return F.concat(F.array(own), others)

    every = F.flatten(F.transform(F.filter("ls", lambda x: F.size(x["hits"]) > 0), lambda x: F.flatten(F.transform(x["hits"], lambda h: of(x, h)))))
    return df.select(*KEYS, F.explode(every).alias("t")).select(*KEYS, "t.*")


def first_best(candidates: DataFrame, field: str, *order: str) -> DataFrame:
    """The candidate of highest confidence of each photo, the first in order of equals."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("confidence"), *order)
    df = candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return shaped(df.withColumn("status", status_of(F.col("confidence"))), field)


def shaped(df: DataFrame, field: str) -> DataFrame:
    for name, kind in (("number", "double"), ("unit", "string"), ("label", "string"), ("value", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.withColumn("field", F.lit(field)).select(*OUT)


CANDIDATE = "array<struct<value:string,number:double,unit:string,confidence:double,match_no:int>>"


def candidate(value: Column, confidence: Column, when: Column, number: Column | None = None, unit: Column | None = None) -> Column:
    """An array of what an attempt gives for its field, or of nothing."""
    none = F.lit(None)
    one = F.struct(value.alias("value"), (none if number is None else number).cast("double").alias("number"), (none if unit is None else unit).cast("string").alias("unit"), confidence.alias("confidence"), F.lit(0).alias("match_no"))
    return F.when(when, F.array(one)).otherwise(F.array().cast(CANDIDATE)).cast(CANDIDATE)


def quantity_of(df: DataFrame, own: Column) -> tuple[DataFrame, Column]:
    """Quantities, never in a serving's context."""
    rx = L.java(L.QUANTITY)
    fits = own & F.col("attempt").rlike(L.QUANTITY_HAS) & ~F.col("attempt").rlike("(?i)" + L.SERVING)
    unit = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.lower(F.regexp_extract("attempt", rx, 2)))
    df = df.withColumn("__unit", F.when(fits, unit))
    n, u = F.col("__number"), F.col("__unit")
    df = df.withColumn("__number", F.when(u.isNotNull(), F.regexp_replace(F.regexp_extract("attempt", rx, 1), ",", ".").try_cast("double")))
    return df, candidate(F.concat_ws(" ", n.cast("string"), u), blend(F.col("strength") * F.col("prox"), F.col("ocr")), F.coalesce(u.isNotNull() & (n > 0) & (n < 1e6), F.lit(False)), n, u)


def price_of() -> Column:
    """Prices; those by unit in brackets and long digit runs don't count."""
    text, rx = F.regexp_replace("attempt", "(?-i)" + L.PER_UNIT, " "), "(?i)" + L.PRICE

    def read(t: Column) -> Column:
        return bound([F.regexp_extract(t, rx, 1), F.regexp_replace(F.regexp_extract(t, rx, 2), ",", ""), F.regexp_extract(t, rx, 3)], judged)

    def judged(currency: Column, whole: Column, part: Column) -> Column:
        pattern = F.when(currency != "", 0.95).when((part != "") | F.col("label_text").rlike("(?i)" + L.CURRENCY), 0.9).otherwise(0.8)
        confidence = blend(F.col("strength") * (pattern * F.col("prox")), F.col("ocr"))
        value = lambda n: F.concat(F.lit("₹"), F.when(n % 1 == 0, n.cast("long").cast("string")).otherwise(F.format_string("%.2f", n)))
        number = F.when(part != "", F.concat_ws(".", whole, part)).otherwise(whole).try_cast("double")
        return bound([number], lambda n: candidate(value(n), confidence, F.coalesce((whole != "") & ~whole.rlike(r"^\d{8,}$") & (n > 0) & (n <= 1e6), F.lit(False)), n))

    return bound([text], read)


def batch_of() -> Column:
    words = F.regexp_extract_all("attempt", F.lit(L.java(L.BATCH)), F.lit(1))
    weight = F.when(F.col("relationship") == "same_line_right", 1.0).otherwise(0.95)
    confidence = blend(F.col("strength") * F.col("prox") * weight, F.col("ocr"))

    def fits(v: Column) -> Column:
        digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
        return ~F.lower(F.regexp_replace(v, r"[\-/]", "")).isin(L.BATCH_STOP) & (digits > 0) & ((digits >= 2) | (F.length(v) >= 5)) & ~v.rlike("[./]") & ~v.rlike(r"^\d{8,}$")

    of = F.transform(words, lambda v, i: F.struct(v.alias("value"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("unit"), confidence.alias("confidence"), i.alias("match_no")))
    return F.filter(of, lambda c: fits(c["value"])).cast(CANDIDATE)


def date_of(df: DataFrame, own: Column) -> tuple[DataFrame, Column]:
    """The matched text is kept as it is; only numeric dates are checked for sense."""
    attempt, clean, numeric, value, year = map(F.col, ("attempt", "__clean", "__numeric", "__date", "__year"))
    outside = F.when(attempt.contains("("), F.regexp_replace(attempt, r"\(.*", "")).otherwise(attempt)
    df = df.withColumn("__clean", F.when(own & attempt.rlike("[0-9]"), F.trim(F.regexp_replace(outside, r"[^0-9./\-A-Za-z]+", " "))))
    df = df.withColumn("__numeric", F.when(clean.rlike(L.DATE_NUMBER_HAS), F.regexp_extract(clean, L.java(L.DATE_NUMBER, False), 0)).otherwise(""))
    # a numeric date ends with its year
    y = F.when(numeric != "", F.regexp_extract(numeric, "[0-9]+$", 0).try_cast("int"))
    v = F.when(numeric != "", numeric).when(clean.rlike(L.DATE_WORD_HAS), F.regexp_extract(clean, L.java(L.DATE_WORD), 0)).otherwise("")
    df = df.withColumns({"__date": v, "__year": y})
    full = F.when(year >= 100, year).when(year <= 49, year + 2000).otherwise(year + 1900)
    return df, candidate(value, blend(F.col("strength") * F.col("prox"), F.col("ocr")), F.coalesce((value != "") & ((numeric == "") | full.between(1990, 2045)), F.lit(False)))


def by_column(read: Callable[[], Column]) -> Callable[[DataFrame, Column], tuple[DataFrame, Column]]:
    return lambda df, own: (df, read())


#: How an attempt at each labelled field is read (columns that it takes on the way, as a column is compiled and an array's function is not,
#: and its candidates), and fields that a label alone leaves unverified.
READERS = {"netQty": quantity_of, "mrp": by_column(price_of), "batch": by_column(batch_of), "mfg": date_of, "exp": date_of}
LABEL_ONLY = ["mrp", "batch", "mfg", "exp"]


#: A line of NET alone, and one that goes on from it.
NET, NET_WRAP = r"(?i)^\s*net\s*$", r"(?i)^\s*(weight|wt\.?|qty\.?|quantity|contents?)(?![A-Za-z0-9_])"


def net_hits(ls: Column) -> Column:
    """A photo's lines, in order, with the further hits of net quantity: NET wrapped over two lines of a block, or alone."""
    hit = lambda x, strength, label: F.struct(F.lit("netQty").alias("field"), (x["line_no"] + 100_000).cast("long").alias("hit_seq"), F.lit(strength).alias("strength"), label.alias("label"), F.lit(False).alias("voted"))

    def more(x: Column, i: Column) -> Column:
        own = lambda o: o["block_no"].eqNullSafe(x["block_no"])
        before = F.try_element_at(F.filter(ls, lambda o, j: (j < i) & own(o)), F.lit(-1))
        after = F.try_element_at(F.filter(ls, lambda o, j: (j > i) & own(o)), F.lit(1))
        wrapped, lone = x["__wrap"] & F.coalesce(before["__net"], F.lit(False)), x["__net"] & ~F.coalesce(after["__wrap"], F.lit(False))
        return F.array_compact(F.array(F.when(wrapped, hit(x, 0.9, F.concat(F.lit("NET "), F.trim(x["text"])))), F.when(lone, hit(x, 0.85, F.lit("NET")))))

    kept = ("line_no", "text", "conf", "cy")
    return F.transform(ls, lambda x, i: F.struct(*[x[n].alias(n) for n in kept], F.when(x["__net"] | x["__wrap"], F.concat(x["hits"], more(x, i))).otherwise(x["hits"]).alias("hits")))


def labelled(lines: DataFrame, *fields: str) -> DataFrame:
    """Observations of labelled fields, one a photo and field: lines are read once for the hits of all fields and shuffled once.

    The candidate of highest confidence wins, the first in order of equals; a label without a candidate is
    unverified at 0.5, where LABEL_ONLY has its field.
    """
    df = with_votes(lines).withColumn("hits", F.concat(*[hits_of(f) for f in fields]))
    df = attempts(df, "netQty" in fields)
    found = F.array().cast(CANDIDATE)
    for reader in dict.fromkeys(READERS[f] for f in fields):
        own = F.col("field").isin([f for f in fields if READERS[f] is reader])
        df, read = reader(df, own)
        found = F.when(own, read).otherwise(found)
    df = df.select(*KEYS, "field", "hit_seq", "attempt_seq", "label", "relationship", F.explode_outer(found).alias("c")).select(*KEYS, "field", "hit_seq", "attempt_seq", "label", "relationship", "c.*")
    w = Window.partitionBy(*KEYS, "field").orderBy(F.desc_nulls_last("confidence"), "hit_seq", "attempt_seq", "match_no")
    df = df.withColumn("rn", F.row_number().over(w)).where("rn = 1").where(F.col("confidence").isNotNull() | F.col("field").isin(LABEL_ONLY))
    only = F.col("confidence").isNull()
    df = df.withColumn("relationship", F.when(only, "label_only").otherwise(F.col("relationship"))).withColumn("status", F.when(only, "unverified").otherwise(status_of(F.col("confidence"))))
    return df.withColumn("confidence", F.coalesce("confidence", F.lit(0.5))).select(*OUT)


def net_quantity(lines: DataFrame) -> DataFrame:
    """Labelled quantities; also NET wrapped over two lines, or alone; never in a serving's context."""
    return labelled(lines, "netQty")


def price(lines: DataFrame) -> DataFrame:
    """Labelled prices; a label alone is unverified."""
    return labelled(lines, "mrp")


def batch(lines: DataFrame) -> DataFrame:
    return labelled(lines, "batch")


def date(lines: DataFrame, field: str) -> DataFrame:
    """field: mfg or exp."""
    return labelled(lines, field)


def block_text(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS, "block_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lines.withColumn("block_text", F.array_join(F.collect_list("text").over(w), "\n"))


def has_vote(kind: str, least: float = L.VOTE_THRESHOLD) -> Column:
    return F.coalesce((F.col("vote_class") == kind) & (F.col("vote_prob") >= least), F.lit(False))


def in_care(lines: DataFrame) -> DataFrame:
    lines = block_text(with_votes(lines))
    w = Window.partitionBy(*KEYS, "block_no")
    return lines.withColumn("voted", has_vote("care")).withColumn("care", matches(F.col("block_text"), "care") | F.max(F.col("voted")).over(w))


def in_long_run(line: Column, match: Column) -> Column:
    """Whether the digits around a match are part of a run of 12 or more, as a barcode's are."""
    start = F.instr(line, match) - 1
    seen = line.substr(start + 1, F.length(match) + 1)
    head = F.when(seen.rlike(r"[^0-9 \-]"), line.substr(F.lit(1), start + F.length(F.regexp_extract(seen, r"^([0-9 \-]*)", 1)))).otherwise(line)
    return F.length(F.regexp_replace(F.regexp_extract(head, r"([0-9 \-]*)$", 1), "[^0-9]", "")) >= 12


def phone(lines: DataFrame) -> DataFrame:
    df = in_care(lines)
    text, care = F.col("text"), F.col("care")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", ""), r"\.+", "-")
    land, free, mobile = (F.regexp_extract(text, L.alone(p), 0) for p in (L.LANDLINE, L.TOLL_FREE, L.MOBILE))
    found = F.array_compact(
        F.array(
            F.when((land != "") & ~in_long_run(text, land), F.struct(clean(land).alias("value"), F.lit(0.95).alias("s"))),
            F.when(free != "", F.struct(clean(free).alias("value"), F.lit(0.95).alias("s"))),
            F.when((mobile != "") & ~in_long_run(text, mobile), F.struct(mobile.alias("value"), F.when(care, 0.8).otherwise(0.55).alias("s"))),
        )
    )
    df = df.select(*KEYS, "line_no", "conf", "care", F.posexplode(found).alias("match_no", "m"))
    df = df.withColumn("confidence", blend(F.col("m.s") * F.when(F.col("care"), 1.0).otherwise(0.85), F.col("conf"))).withColumn("value", F.col("m.value")).withColumn("relationship", F.lit("line_pattern"))
    return first_best(df, "carePhone", "line_no", "match_no")


def email(lines: DataFrame) -> DataFrame:
    df = in_care(lines).withColumn("m", F.regexp_extract("text", L.EMAIL, 0)).where("m <> ''")
    freed = F.regexp_extract("m", r"^\d+(AND)?([A-Za-z][A-Za-z0-9._%+\-]+@.*)", 2)
    value = F.regexp_replace(F.when(freed != "", freed).otherwise(F.col("m")), "^[^A-Za-z0-9]+", "")
    df = df.withColumn("value", value).where(F.col("value").contains("@"))
    df = df.withColumn("confidence", blend(F.when(F.col("care"), 0.95).otherwise(0.7), F.col("conf"))).withColumn("relationship", F.lit("line_pattern"))
    return first_best(df, "careEmail", "line_no")


def fssai(lines: DataFrame) -> DataFrame:
    """A number of 14 digits in a block that has a licence label, or a line voted to be one."""
    df = block_text(with_votes(lines))
    voted = F.max(has_vote("fssai")).over(Window.partitionBy(*KEYS, "block_no"))
    df = df.withColumn("gate", matches(F.col("block_text"), "fssai") | voted).where("gate").withColumn("value", F.regexp_extract("text", L.alone(r"\d{14}"), 0)).where("value <> ''")
    df = df.withColumn("confidence", blend(F.lit(0.95), F.col("conf"))).withColumn("relationship", F.lit("block_gated"))
    return first_best(df, "fssai", "line_no")


def first_line(df: DataFrame, field: str) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("line_no")
    df = df.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return shaped(df.withColumn("status", status_of(F.col("confidence"))), field)


def origin(lines: DataFrame) -> DataFrame:
    """The first labelled origin, not the best."""
    df = hits(with_votes(lines), "origin")
    # a colon after the label stays and counts towards the least length
    value = F.trim(F.element_at(F.split(F.trim(after_label(df)), "[.,;]"), 1))
    df = df.withColumn("value", F.initcap(value)).where(F.length("value") >= 3)
    df = df.withColumn("confidence", blend(F.col("strength"), F.col("conf"))).withColumn("relationship", F.lit("same_line_right"))
    return first_line(df, "origin")


def barcode(lines: DataFrame) -> DataFrame:
    df = lines.withColumn("value", F.regexp_replace("text", "[^0-9]", "")).withColumn("rest", F.regexp_replace("text", r"[\d\s]", ""))
    df = df.where((F.length("value") >= 8) & (F.length("rest") <= 2))
    df = df.withColumn("confidence", blend(F.when(F.col("top") > 0.55, 0.9).otherwise(0.6), F.col("conf"))).withColumn("relationship", F.lit("digit_run"))
    return first_line(df, "barcode")


def in_block(lines: DataFrame) -> DataFrame:
    """lines with `in_block`: the numbers and trimmed texts of its block's lines, which a photo bounds. A join of lines with lines would be broadcast by its estimated size, which leaves out that rows are exploded."""
    w = Window.partitionBy(*KEYS, "block_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return lines.withColumn("in_block", F.collect_list(F.struct("line_no", F.trim("text").alias("text"))).over(w))


def followers(start: DataFrame) -> DataFrame:
    """start, lines of in_block, with `following`: the trimmed texts of its block's later lines, in order."""
    later = F.sort_array(F.filter("in_block", lambda x: x["line_no"] > F.col("line_no")))
    return start.withColumn("following", F.transform(later, lambda x: x["text"])).drop("in_block")


def manufacturer(lines: DataFrame) -> DataFrame:
    """Name and address after the label within its block: up to four pieces, until another label."""
    df = hits(in_block(with_votes(lines)), "manufacturer")
    full = F.expr("substring(text, locate(lower(label), lower(text)) + length(label))")
    df = followers(df.withColumn("rest", F.trim(full)))
    first = F.when((F.col("rest") != "") & ~F.lower("rest").contains("address above"), F.array("rest")).otherwise(F.array().cast("array<string>"))
    zero = F.struct(first.alias("got"), F.lit(False).alias("stopped"))

    def step(a: Column, t: Column) -> Column:
        stop = t.rlike("(?i)" + L.NEXT_LABEL) & (F.size(a["got"]) > 0)
        done = a["stopped"] | (F.size(a["got"]) >= 4)
        return F.when(done | (t == ""), a).when(stop, F.struct(a["got"].alias("got"), F.lit(True).alias("stopped"))).otherwise(F.struct(F.array_append(a["got"], t).alias("got"), F.lit(False).alias("stopped")))

    df = df.withColumn("got", F.aggregate("following", zero, step, lambda a: a["got"])).where(F.size("got") > 0)
    df = df.withColumn("value", F.trim(F.regexp_replace(F.element_at("got", 1), r"^[\s:,\-]+", ""))).where(F.length("value") >= 3)
    strong = F.array_join("got", " ").rlike(r"(?<![A-Za-z0-9_])[1-9]\d{5}(?![A-Za-z0-9_])") | (F.size("got") >= 3)
    df = df.withColumn("confidence", blend(F.col("strength") * F.when(strong, 0.95).otherwise(0.7), F.col("conf"))).withColumn("relationship", F.lit("block_capture"))
    # the address is carried as the unit of this field's data
    df = df.withColumn("unit", F.array_join(F.slice("got", 2, 4), ", "))
    return first_best(df, "manufacturer", "line_no")


def role(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.contains("import"), "importer").when(low.contains("market"), "marketer").when(low.contains("pack") | low.contains("pkd"), "packer").otherwise("manufacturer")


def block_field(lines: DataFrame, field: str, pattern: str, kind: str | None = None) -> DataFrame:
    """Text from a matching line to the block's end or next label, from 12 characters, cut at 600.

    A line voted to be of the class `kind` begins one as well, as a whole if it does not match.
    """
    lines = in_block(with_votes(lines))
    rx = "(?i)" + pattern
    df = lines.withColumn("voted", has_vote(kind, L.BLOCK_VOTE) if kind else F.lit(False)).where(F.col("text").rlike(rx) | F.col("voted"))
    df = df.withColumn("label", F.nullif(F.regexp_extract("text", rx, 0), F.lit("")))
    df = df.withColumn("head", F.trim(F.when(F.col("label").isNull(), F.col("text")).otherwise(F.expr("substring(text, instr(text, label))"))))
    df = followers(df)
    zero = F.struct(F.col("head").alias("got"), F.lit(False).alias("stopped"))

    def step(a: Column, t: Column) -> Column:
        stop = a["stopped"] | t.rlike("(?i)" + L.NEXT_LABEL) | (F.length(a["got"]) >= 1200)
        return F.when(stop, F.struct(a["got"].alias("got"), F.lit(True).alias("stopped"))).otherwise(F.struct(F.concat_ws(" ", a["got"], t).alias("got"), F.lit(False).alias("stopped")))

    df = df.withColumn("got", F.trim(F.aggregate("following", zero, step, lambda a: a["got"]))).where(F.length("got") >= 12)
    df = df.withColumn("value", F.when(F.length("got") > 600, F.concat(F.substring("got", 1, 600), F.lit("…"))).otherwise(F.col("got")))
    df = df.withColumn("confidence", blend(F.lit(0.9), F.col("conf"))).withColumn("relationship", F.when(F.col("voted"), "classifier_block_capture").otherwise("block_capture"))
    return first_line(df, field)


def identity(lines: DataFrame) -> DataFrame:
    """brand, productName and genericName from the tallest lines of the top."""
    lines = with_votes(lines)
    t = F.trim("text")
    digits, words = F.length(F.regexp_replace(t, "[^0-9]", "")), F.size(F.split(t, r"\s+"))
    veto = F.coalesce(F.col("vote_class").isin(L.IDENTITY_VETO) & (F.col("vote_prob") > 0.6), F.lit(False))
    fits = F.length(t).between(2, 60) & (F.col("top") <= 0.42) & (F.coalesce("height", F.lit(0.02)) >= 0.008) & ~t.rlike(L.java(L.NOT_A_NAME)) & ~t.endswith("!") & ~veto & (digits <= F.length(t) / 2) & (words <= 8)
    w = Window.partitionBy(*KEYS)
    df = lines.where(fits).withColumn("rn", F.row_number().over(w.orderBy(F.desc(F.coalesce("height", F.lit(0.02))), "line_no"))).withColumn("n", F.count("*").over(w)).where("rn <= 2")
    boost = F.when(F.col("vote_class").isin("brand", "product_name") & (F.col("vote_prob") >= L.VOTE_THRESHOLD), 0.15).otherwise(0.0)
    score = lambda s: F.least(blend(F.lit(s), F.col("conf")) + boost, F.lit(0.95))
    df = df.withColumn("value", t).withColumn("relationship", F.lit("prominent"))
    brand = df.where("rn = 1").withColumn("confidence", score(0.75))
    brand = shaped(brand.withColumn("status", status_of(F.col("confidence"))), "brand")
    single = F.col("n") == 1
    lone = single & (words < 2)
    product = df.where(((F.col("n") >= 2) & (F.col("rn") == 2)) | single).withColumn("confidence", F.when(lone, blend(F.lit(0.5), F.col("conf"))).otherwise(score(0.8)))
    product = shaped(product.withColumn("status", F.when(lone, "unverified").otherwise(status_of(F.col("confidence")))), "productName")
    generic = product.withColumn("field", F.lit("genericName")).withColumn("status", F.when((F.col("status") == "found") & (F.col("confidence") >= 0.6), "found").when(F.col("value").isNotNull(), "unverified").otherwise("notFound"))
    return brand.unionByName(product).unionByName(generic)


def product(lines: DataFrame) -> DataFrame:
    """All fields of every photo that have an observation."""
    parts = [
        identity(lines), labelled(lines, *READERS), manufacturer(lines), phone(lines), email(lines), fssai(lines), origin(lines), barcode(lines),
        block_field(lines, "ingredients", r"^\s*ingredients?(?![A-Za-z0-9_])", "ingredients"), block_field(lines, "allergen", r"allergen|contains:", "allergen"),
    ]
    return reduce(DataFrame.unionByName, parts)
