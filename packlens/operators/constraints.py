"""Rules of a table's columns, kept by one projection: values are put in shape, rows that break a rule leave with their reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packlens.functions.text import bound


@dataclass(frozen=True)
class Rule:
    """What a column, or a member of a struct by its dotted path, must be. Shapes come before demands: default, trim, lower, then required, least, most, one_of."""

    column: str
    required: bool = False
    trim: bool = False
    lower: bool = False
    default: object = None
    least: float | None = None
    most: float | None = None
    one_of: tuple[str, ...] = ()


#: Rules of products, users, scans and catalogs (fixed values).
PRODUCT = [
    *[Rule(c, required=True, trim=True) for c in ("productName", "brand", "manufacturer.name", "manufacturer.address", "batchNumber", "netQuantity")],
    Rule("category", required=True, trim=True, lower=True),
    *[Rule(c, required=True, least=0) for c in ("mrp", "sellingPrice")],
    *[Rule(c, required=True) for c in ("manufacturingDate", "expiryDate")],
]
USER = [
    Rule("name", required=True, trim=True),
    Rule("email", required=True, trim=True, lower=True),
    Rule("passwordHash", required=True),
    Rule("role", default="officer", one_of=("officer", "supervisor", "admin")),
]
SCAN = [
    Rule("productName", required=True, trim=True),
    Rule("category", default="general", lower=True, one_of=("general", "food")),
    *[Rule(c, default="") for c in ("thumbnailUrl", "ocrText", "officerName")],
    Rule("verdict", default="needsReview", one_of=("compliant", "nonCompliant", "needsReview")),
    Rule("score", default=0, least=0, most=100),
    Rule("photoCount", default=1),
    *[Rule(c, default=0) for c in ("meanConfidence", "regionCount")],
    Rule("serverValidated", default=False),
]
#: White space that trimming takes away.
_SPACE = r"^[\s\x{FEFF}\x{A0}\p{Z}]+|[\s\x{FEFF}\x{A0}\p{Z}]+\z"


def shaped(value: Column, kind: str, rule: Rule) -> Column:
    if rule.default is not None:
        value = F.coalesce(value, F.lit(rule.default).cast(kind))
    if kind == "string" and rule.trim:
        value = F.regexp_replace(value, _SPACE, "")
    return F.lower(value) if kind == "string" and rule.lower else value


def broken(value: Column, kind: str, rule: Rule) -> list[Column]:
    """For each demand of the rule, its name where the value breaks it, else null. An absent value breaks only `required`."""
    out = []
    if rule.required:
        out.append(F.when(value.isNull() | (value == "") if kind == "string" else value.isNull(), "required"))
    if rule.least is not None:
        out.append(F.when(value < rule.least, "min"))
    if rule.most is not None:
        out.append(F.when(value > rule.most, "max"))
    if rule.one_of:
        out.append(F.when(~value.isin(*rule.one_of), "enum"))
    return out


def evaluated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with values in shape and `broken`, an array of (column, broken) in the order of the rules. A column that df lacks is null throughout."""
    tops: dict[str, list[Rule]] = {}
    for r in rules:
        tops.setdefault(r.column.split(".")[0], []).append(r)
    kinds = {r.column: _kind(df, r.column) for r in rules}
    new = {}
    for top, own in tops.items():
        if top not in df.columns:
            default = next((r.default for r in own if "." not in r.column), None)
            if default is not None:
                new[top] = F.lit(default)
            continue
        value = F.col(f"`{top}`")
        for r in own:
            at = r.column.partition(".")[2]
            if not at:
                value = shaped(value, kinds[r.column], r)
            elif kinds[r.column] is not None:
                # a struct that is null stays so
                value = F.when(value.isNotNull(), value.withField(at, shaped(value[at], kinds[r.column], r)))
        new[top] = value
    df = df.withColumns(new)
    there = [r.column.split(".")[0] in df.columns and _kind(df, r.column) is not None for r in rules]
    values = [F.col(r.column) if own else F.lit(None).cast("string") for r, own in zip(rules, there, strict=True)]

    def judged(*shown: Column) -> Column:
        of = [(r, b) for r, own, v in zip(rules, there, shown, strict=True) for b in broken(v, _kind(df, r.column) if own else "string", r)]
        return F.array_compact(F.array(*[F.when(b.isNotNull(), F.struct(F.lit(r.column).alias("column"), b.alias("broken"))) for r, b in of]))

    # values are put in shape once, however often their rules ask for them
    demands = any(r.required or r.least is not None or r.most is not None or r.one_of for r in rules)
    return df.withColumn("broken", bound(values, judged) if demands else F.array().cast("array<struct<column:string,broken:string>>"))


def _kind(df: DataFrame, path: str) -> str | None:
    """The type's name at a dotted path, none where there is no such member."""
    kind = df.schema
    for name in path.split("."):
        if name not in getattr(kind, "names", []):
            return None
        kind = kind[name].dataType
    return kind.simpleString()


def constrained(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, in shape; rows that break some, with `broken`)."""
    df = evaluated(df, rules)
    return df.where(F.size("broken") == 0).drop("broken"), df.where(F.size("broken") > 0)


def reasons(bad: DataFrame) -> DataFrame:
    """(column, broken, count): how many rows break what."""
    return bad.select(F.explode_outer("broken").alias("b")).where("b is not null").groupBy("b.column", "b.broken").count().orderBy("column", "broken")
