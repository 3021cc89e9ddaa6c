"""Cleaning of recognised label text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUOTES = "'\"`‘’“”"
#: Misread words and what they stand for, by lower-case spelling (fixed values).
FIXES = {
    "sodum": "Sodium", "sodiumb": "Sodium", "falb": "Fat", "fal": "Fat", "fines": "FINES", "sugas": "Sugars", "sugrs": "Sugars", "sagaswb": "Sugars", "sugrswb": "Sugars", "sagr": "Sugar",
    "protoin": "Protein", "protien": "Protein", "enengy": "Energy", "enegy": "Energy", "carbohyrate": "Carbohydrate", "carbohydrats": "Carbohydrate", "kcd": "kcal", "kacl": "kcal", "kcad": "kcal",
    "saturaded": "Saturated", "saturatedf": "Saturated Fat", "transfatb": "Trans Fat", "ntients": "Nutrients", "nutriant": "Nutrient", "rdaperse": "RDA Per Serve", "rdapersee": "RDA Per Serve",
    "servese": "Serve Size", "servese2wb": "Serve Size", "nutritionalinformation": "NUTRITIONAL INFORMATION", "allergenadvice": "ALLERGEN ADVICE", "contans": "Contains", "contanssoy": "Contains Soy",
    "mak": "Milk", "vogetableoi": "Vegetable Oil", "vogetable": "Vegetable", "eosble": "Edible", "ldioedsat": "Iodised Salt", "maltodedin": "Maltodextrin", "ingrediants": "INGREDIENTS", "netqty": "NET QTY",
    "servingperpack": "Servings per pack", "mfg": "Mfg.", "exp": "Exp.", "cholestrol": "Cholesterol", "cholesteroi": "Cholesterol", "fibra": "Fibre", "vitamln": "Vitamin", "vitamins": "Vitamins",
    "calcum": "Calcium", "potasslum": "Potassium", "niacln": "Niacin", "riboflavln": "Riboflavin", "thiamln": "Thiamine", "presarvative": "Preservative", "emulsifler": "Emulsifier",
    "stablizer": "Stabilizer", "antioxidant": "Antioxidant", "reguiator": "Regulator", "palmolein": "Palmolein", "lic": "Lic.", "fssai": "FSSAI", "wheat": "Wheat", "gluten": "Gluten",
    "peanut": "Peanut", "mustard": "Mustard", "sesame": "Sesame",
}
#: Words of labels that near misses are snapped to, in order of preference (fixed values).
VOCABULARY = [
    "INGREDIENTS", "NUTRITIONAL", "INFORMATION", "Energy", "Protein", "Carbohydrate", "Sugars", "Added", "Total", "Fat", "Saturated", "Trans", "Sodium", "Nutrients", "Serve", "Size", "Servings",
    "Contains", "Allergen", "Advice", "Vegetable", "Edible", "Potato", "Chips", "Proprietary", "Food", "Manufacturing", "Consumer", "Feedback", "Batch", "Gurugram", "Haryana", "India", "PepsiCo",
    "Hydrolysed", "Maltodextrin", "Flavour", "Seasoning", "Condiments", "Cheese", "Powder", "Consumption", "Cholesterol", "Fibre", "Calcium", "Iron", "Potassium", "Magnesium", "Zinc", "Vitamin",
    "Vitamins", "Niacin", "Riboflavin", "Thiamine", "FSSAI", "Lic", "MRP", "Inclusive", "Taxes", "Quantity", "Weight", "Expiry", "Date", "Month", "Year", "Customer", "Care", "Address", "Marketed",
    "Manufactured", "Packed", "Milk", "Soy", "Wheat", "Gluten", "Peanut", "Mustard", "Sesame", "Sulphite", "Lactose", "Casein", "Whey", "Sugar", "Salt", "Palm", "Palmolein", "Rice", "Bran", "Corn",
    "Maize", "Starch", "Spices", "Acidity", "Regulator", "Emulsifier", "Stabilizer", "Preservative", "Antioxidant", "Colour", "Dextrose", "Fructose", "Cocoa", "Yeast", "Onion", "Garlic", "Tomato",
]
PUNCTUATION = r"""^['"`‘’“”.,;:|!*_~^+\-=–—/\\()\[\]{}<>]+$"""
_END = "(?![A-Za-z0-9_])"
_START = "(?<![A-Za-z0-9_])"


def bound(values: list[Column], body) -> Column:
    """body of values that are computed once each."""
    return F.transform(F.array(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])), lambda x: body(*[x[f"v{i}"] for i in range(len(values))]))[0]


def table_of(values: dict[str, str]) -> Column:
    """A constant map, small in the plan: a map of literals is walked by every rule of the planner, wherever it is used."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in values.items())), F.lit("\n"), F.lit("\t"))


def swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for pattern, to in pairs:
        text = F.regexp_replace(text, pattern, to)
    return text


def without_quotes(text: Column) -> Column:
    """Quotes go, but one between letters becomes an apostrophe; then unbalanced outer brackets go."""
    q = f"[{QUOTES}]"
    text = swap(text, (f"(?<![A-Za-z]){q}|{q}(?![A-Za-z])", ""), (q, "'"))
    return F.trim(F.regexp_replace(peeled(text), r'\s*"\s*', ""))


def peeled(text: Column) -> Column:
    """Leading openers and trailing closers that have no partner, peeled one at a time."""
    pairs = [("(", ")"), ("[", "]"), ("{", "}"), ("<", ">")]
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))

    def step(s: Column, _: Column) -> Column:
        out = F.when(F.length(s) <= 1, s)
        for a, b in pairs:
            out = out.when(s.startswith(a) & (count(s, a) > count(s, b)), F.ltrim(s.substr(F.lit(2), F.length(s))))
        for a, b in pairs:
            out = out.when(s.endswith(b) & (count(s, b) > count(s, a)), F.rtrim(s.substr(F.lit(1), F.length(s) - 1)))
        return out.otherwise(s)

    text = F.trim(text)
    return F.when(text.rlike(r"^[(\[{<]|[)\]}>]$"), F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), text, step)).otherwise(text)


def clean_token(text: Column) -> Column:
    text = F.trim(F.regexp_replace(F.trim(text), r"\s+", " "))
    text = F.trim(F.regexp_replace(without_quotes(text), r"\s+", " "))
    energy = "(kcd|kacl|kcad)"
    return F.trim(
        swap(
            text,
            (r"(\d)\s*([.,])\s*(\d)", "$1$2$3"),
            (rf"(?i)(\d)\s*{energy}{_END}", "$1 kcal"),
            (rf"(?i){_START}{energy}{_END}", "kcal"),
            (rf"(?i)(\d)(kcal|mg|ml|kg){_END}", "$1 $2"),
            (rf"(\d)g{_END}", "$1 g"),
            (r"(\d)\s+%", "$1%"),
        )
    )


def snapped(word: Column) -> Column:
    """The vocabulary's word nearest to a lower-case word, null beyond 1 edit, or 2 from 9 letters with the same first letter."""
    # the words whose length is at most 2 off, by a word's length, in order of preference
    of_length = [" ".join(w for w in VOCABULARY if abs(len(w) - n) <= 2) for n in range(1, max(map(len, VOCABULARY)) + 3)]
    near = F.get(F.array(*[F.split(F.lit(ws), " ") for ws in of_length]), F.length(word) - 1)
    far = F.transform(near, lambda w, i: F.struct(F.levenshtein(F.lower(w), word, 2).alias("d"), i.alias("i"), w.alias("word")))
    best = F.array_min(F.filter(far, lambda x: x["d"] >= 0))
    limit = F.when(F.length(word) >= 9, 2).otherwise(1)
    same = lambda b: F.lower(F.substring(b["word"], 1, 1)) == F.substring(word, 1, 1)
    return bound([best], lambda b: F.when((b["d"] <= limit) & ((b["d"] < 2) | same(b)), b["word"]))


def fixed_word(word: Column, split: bool = True) -> Column:
    """A word by the fixes and the vocabulary, keeping its capitals and what surrounds its letters."""
    numeric = word.rlike(r"(?i)^[\d.,/%\-+()gmlkach]+$") & word.rlike(r"\d")
    bare = F.regexp_replace(F.lower(word), "^[^a-z]+|[^a-z]+$", "")
    lead, trail = F.regexp_extract(word, "^[^A-Za-z]+", 0), F.regexp_extract(word, "[^A-Za-z]+$", 0)
    upper = word == F.upper(word)
    fixes = table_of(FIXES)

    def by_fix(low: Column, exact: Column) -> Column:
        known = F.concat(lead, F.when(upper, F.upper(exact)).otherwise(exact), trail)
        return F.when(numeric | (low == ""), word).when(exact.isNotNull(), known).otherwise(bound([F.when(F.length(low) >= 6, snapped(low))], by_vocabulary))

    def by_vocabulary(snap: Column) -> Column:
        cased = F.when(upper, F.upper(snap)).when(word.rlike("^[A-Z]"), F.concat(F.upper(F.substring(snap, 1, 1)), snap.substr(F.lit(2), F.length(snap)))).otherwise(snap)
        out = F.when(snap.isNotNull(), F.concat(lead, cased, trail))
        if split:
            parts = F.split(F.regexp_replace(word, "([a-z])([A-Z])", "$1 $2"), " ")
            out = out.when(word.rlike("[a-z][A-Z]"), F.array_join(F.transform(parts, lambda p: fixed_word(p, False)), " "))
        return out.otherwise(word)

    return bound([bare], lambda low: bound([F.try_element_at(fixes, low)], lambda exact: by_fix(low, exact)))


def fixed_line(line: Column, lexicon: bool = True) -> Column:
    line = swap(
        line,
        ("([:;])(?=[A-Za-z0-9])", "$1 "),
        (",(?=[A-Za-z])", ", "),
        (r"([A-Za-z])(\()", "$1 $2"),
        (r"(?i)NUTRITIONAL\s?INFORMATION", "NUTRITIONAL INFORMATION"),
        (rf"(?i)([A-Za-z])(INFORMATION){_END}", "$1 $2"),
        (rf"(?i){_START}SERVE\s?SIZE{_END}", "SERVE SIZE"),
        (rf"(?i){_START}ALLERGEN\s?ADVICE{_END}", "ALLERGEN ADVICE"),
        (rf"(?i){_START}Per\s?100\s?g{_END}", "Per 100g"),
    )
    if lexicon:
        line = F.array_join(F.transform(F.split(line, " "), lambda w: fixed_word(w)), " ")
    return F.trim(F.regexp_replace(line, r"\s{2,}", " "))


def clean_line(line: Column) -> Column:
    return fixed_line(clean_token(line))


def keep_token(text: Column, width: Column, height: Column, conf: Column) -> Column:
    """Whether a recognised region is more than noise; width is null without a box."""
    raw = F.trim(text)
    # a text of letters and digits alone is its own probe
    plain = raw.rlike("^[A-Za-z0-9]+$")
    probe = F.trim(without_quotes(raw))
    said = plain | ((raw != "") & ~raw.rlike(PUNCTUATION) & bound([probe], lambda p: (p != "") & ~p.rlike(PUNCTUATION)))
    boxed = (width >= 6) & (height >= 6) & (conf >= 0.5) & said
    return (raw != "") & F.when(width.isNull(), F.length(raw) >= 2).otherwise(boxed)


def unwrapped(lines: DataFrame, *keys: str) -> DataFrame:
    """Lines with words that a hyphen cut at the line's end joined to the next line, however often."""
    w = Window.partitionBy(*keys).orderBy("line_no")
    before = F.lag("text").over(w)
    new = ~F.coalesce(before.endswith("-") & F.col("text").rlike("^[a-z]"), F.lit(False))
    df = lines.withColumn("goes_on", F.coalesce(F.lead("text").over(w).rlike("^[a-z]"), F.lit(False)) & F.col("text").endswith("-")).withColumn("part", F.sum(new.cast("int")).over(w))
    piece = F.when(F.col("goes_on"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    df = df.withColumn("piece", piece).groupBy(*keys, "part").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("ps"))
    return df.select(*keys, "line_no", F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("text"))


def phone_format(text: Column) -> Column:
    return swap(text, (r"\s+", ""), (r"\.+", "-"))


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(swap(F.lower(F.trim(text)), ("[^a-z0-9]+", "_"), ("^_+|_+$", "")), F.lit("")), F.lit("scan"))
