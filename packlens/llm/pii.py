"""Personal data by regexes and bootstrapped contexts (operator 4).

Base kinds are matched directly and are the seeds. The words before and after a token are its lexical
patterns, the token is an instance. Spark iterates over the graph of patterns and instances until
nothing new is trusted: a pattern is by the share of its instances that are, an untried instance by
any such pattern. Trusted patterns then mark identifiers that no regex knows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base

KINDS = ["email", "ip", "card", "phone", "id"]
#: The domain, matched after each '@'; what stands before it is taken from the characters of LOCAL.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: A match only begins with a run of digits, so that long runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = re.compile(r"""[^\s"'<>,;:=()\[\]]+|[:=]""")
#: What an untried identifier has at least.
LEAST_CHARS, LEAST_DIGITS = 4, 1
#: Plain words are first counted in one of so many documents; patterns that are looked for in one pass at most.
FIRST_SHARE, PATTERNS_AT_ONCE = 16, 1 << 20
#: What a pattern needs to be trusted, and the instances assumed wrong for each pattern.
CONFIDENCE, SUPPORT, DOUBT = 0.6, 3, 1.0
#: Patterns by the places of their words from the instance.
PATTERNS = [(-2, -1), (-3, -2, -1), (-1, 1), (1, 2)]
PLAIN, UNTRIED, SEED = 0, 1, 2
SPAN = "struct<start:int,rank:int,end:int>"
FOUND = "array<struct<patterns:array<long>,instance:long,role:int,start:int,end:int>>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found outwards from each '@' in linear time."""
    free, i = 0, text.find("@")
    while i >= 0:
        name = text[free:i]
        start = free + len(name.rstrip(LOCAL))
        found = DOMAIN.match(text, i + 1) if start < i else None
        if found:
            yield start, found.end()
        free = found.end() if found else i + 1
        i = text.find("@", free)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in code points, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, role) of words, cue marks and seeds; a mark's role is PLAIN."""
    out, free = [], 0
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        if start < free:
            continue
        for m in TOKEN.finditer(text, free, start):
            word = m[0].rstrip(".!?")
            if word:
                digits = len(word) >= LEAST_CHARS and len(DIGIT.findall(word)) >= LEAST_DIGITS
                out.append((m.start(), m.start() + len(word), UNTRIED if digits else PLAIN))
        if end > start:
            out.append((start, end, SEED))
        free = end
    return out


def graph(text: str, spans: list[tuple[int, int, int]], known: dict[str, int]) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray]:
    """(tokens, number of each, patterns of each): a pattern is 0 where the nearest word lies outside the text. known caches words' numbers."""
    at = tokens(text, spans)
    numbers = np.zeros(len(at) + 6, np.int64)
    for i, (a, b, _) in enumerate(at):
        word = text[a:b]
        n = known.get(word)
        if n is None:
            n = known[word] = number(word.lower())
        numbers[i + 3] = n
    out, n = np.zeros((len(PATTERNS), len(at)), np.int64), len(at)
    roles = np.array([r for *_, r in at], np.int64)
    # a seed's own text does not matter where it is context
    words = numbers.view(np.uint64).copy()
    words[3 : n + 3][roles == SEED] = 1
    for k, places in enumerate(PATTERNS):
        total = np.full(n, k + 1, np.uint64)
        for x in places:
            total = (total ^ words[3 + x : 3 + x + n]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        inside = np.ones(n, bool)
        for x in places:
            if abs(x) == 1:
                inside &= (np.arange(n) + x >= 0) & (np.arange(n) + x < n)
        out[k] = np.where(inside, total.view(np.int64), 0)
    return at, numbers[3 : n + 3], out


def read(docs: DataFrame) -> DataFrame:
    text = base.text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), base.row_key(text).alias("rid"), text.alias("text"))


def extracted(docs: DataFrame) -> DataFrame:
    """doc_id, rid, base (sorted spans) and found (seeds and untried instances with their patterns) of every row."""
    schema = f"doc_id long, rid long, base array<{SPAN}>, found {FOUND}"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("patterns", pa.list_(pa.int64())), ("instance", pa.int64())] + [(n, pa.int32()) for n in ("role", "start", "end")]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found, known = [], [], {}
            for x in batch.column("text"):
                text = x.as_py()
                own = base_spans(text)
                spans.append([{"start": a, "rank": k, "end": b} for a, k, b in own])
                rows = []
                if own or DIGIT.search(text):
                    at, numbers, patterns = graph(text, own, known)
                    for i, (a, b, role) in enumerate(at):
                        if role != PLAIN:
                            rows.append({"patterns": [p for p in patterns[:, i].tolist() if p], "instance": int(numbers[i]), "role": role, "start": a, "end": b})
                found.append(rows)
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array(spans, spans_type), pa.array(found, found_type)], names=["doc_id", "rid", "base", "found"])

    return read(docs).mapInArrow(extract, schema)


def plain_pairs(docs: DataFrame, wanted: pa.Table) -> DataFrame:
    """(pattern, instance): plain words in the wanted patterns, of each pattern and task one more than its limit at most."""
    order = np.argsort(wanted["pattern"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast((wanted["pattern"].to_numpy()[order], wanted["limit"].to_numpy()[order]))  # PATTERNS_AT_ONCE at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, limits = shared.value
        held, full, known = defaultdict(set), np.zeros(len(patterns), bool), {}
        for batch in batches:
            known.clear()
            for x in batch.column("text"):
                text = x.as_py()
                at, numbers, found = graph(text, base_spans(text), known)
                plain = np.array([r == PLAIN and text[a] not in ":=" for a, _, r in at], bool)
                for row in found:
                    near = np.minimum(np.searchsorted(patterns, row), len(patterns) - 1)
                    hit = plain & (patterns[near] == row) & ~full[near]
                    for k, i in zip(near[hit].tolist(), numbers[hit].tolist(), strict=True):
                        held[k].add(i)
                        full[k] = len(held[k]) > limits[k]
        pairs = [(int(patterns[k]), i) for k, own in held.items() for i in own]
        yield pa.record_batch([pa.array([p for p, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["pattern", "instance"])

    return docs.select("text").mapInArrow(count, "pattern long, instance long").distinct()


def plain_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, plain): how many different plain words stand in each wanted pattern (pattern, limit) in all texts.

    Above its limit a pattern is out, so its count may stop there. Frequent patterns pass it in a share of
    the documents; only the others are looked for in the rest.
    """
    docs, spark = read(docs), docs.sparkSession
    first = F.pmod("rid", F.lit(FIRST_SHARE)) == 0
    blocks = -(-wanted.count() // PATTERNS_AT_ONCE)
    out = spark.createDataFrame([], "pattern long, plain long")
    for block in range(blocks):
        own = wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        some = base.keep(plain_pairs(docs.where(first), own.toArrow()), "plain_in_share")
        counts = some.groupBy("pattern").agg(F.count("*").alias("plain"))
        beyond = base.keep(counts.join(own, "pattern").where("plain > limit").select("pattern", "plain"), "beyond")
        left = own.join(beyond, "pattern", "left_anti").toArrow()
        if left.num_rows:
            pairs = some.join(beyond, "pattern", "left_anti").unionByName(plain_pairs(docs.where(~first), left)).distinct()
            out = out.unionByName(base.keep(pairs.groupBy("pattern").agg(F.count("*").alias("plain")), "plain"))
        out = out.unionByName(beyond)
    return out


def trusted(edges: DataFrame, plain: DataFrame | None, confidence: float, support: int) -> DataFrame:
    """(pattern, n): patterns that are trusted when no further pattern or instance is, and the instances of each.

    A pattern's confidence is the number of its trusted instances over all of them plus DOUBT, each
    different instance counted once. Trust only grows, so the end does not depend on the order.
    """
    known, good, n, last = None, None, 0, -1
    if plain is not None:
        edges = base.keep(edges.join(plain, "pattern", "left").withColumn("plain", F.coalesce("plain", F.lit(0))), "edges")
    while n > last:
        trust = F.col("role") == SEED
        df = edges if known is None else edges.join(known, "instance", "left")
        trust = trust if known is None else trust | F.col("good").isNotNull()
        more = F.max("plain") if plain is not None else F.lit(0)
        patterns = df.groupBy("pattern").agg(F.sum(trust.cast("long")).alias("support"), (F.count("*") + more).alias("n"))
        good = base.keep(patterns.where((F.col("support") >= support) & (F.col("support") / (F.col("n") + DOUBT) >= confidence)).select("pattern", "n"), "patterns")
        last, n = n, good.count()
        if not n or n == last:
            return good
        known = edges.where(F.col("role") == UNTRIED).join(good, "pattern").select("instance").distinct().withColumn("good", F.lit(True))
    return good


def trusted_patterns(docs: DataFrame, found: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern): contexts whose instances are, by the graph, personal identifiers.

    Plain words only lower a pattern's confidence, so they are counted for those patterns alone that
    would be trusted without them.
    """
    edges = found.select(F.explode("found").alias("c")).select(F.explode("c.patterns").alias("pattern"), F.col("c.instance").alias("instance"), F.col("c.role").alias("role"))
    edges = base.keep(edges.groupBy("pattern", "instance").agg(F.max("role").alias("role")), "edges")
    most = trusted(edges, None, confidence, support)
    if most.isEmpty():
        return most.select("pattern")
    # with all n instances trusted, more plain words than this leave a pattern below the confidence (1 for rounding)
    limit = F.floor(F.col("n") / confidence - F.col("n") - DOUBT) + 1
    plain = plain_counts(docs, most.select("pattern", limit.alias("limit")))
    return trusted(edges.join(most.select("pattern"), "pattern"), plain, confidence, support).select("pattern")


def personal_data(docs: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """doc_id and spans (start, rank, end), sorted, for every row of docs; rank is the place in KINDS.

    A null or empty text has no spans. Null ids and repeated rows are rows like others. An empty table
    gives no rows; other columns are ignored. Whole texts of any length are read. Identifiers that are found
    by their context alone have at least LEAST_CHARS characters and LEAST_DIGITS digits: shorter ones, and
    words without a digit, are not found that way. Patterns of equal confidence are trusted alike.
    """
    found = base.keep(extracted(docs), "extracted")
    good = trusted_patterns(docs, found.where(F.size("found") > 0), confidence, support)
    untried = found.select("rid", F.explode("found").alias("c")).where(F.col("c.role") == UNTRIED)
    untried = untried.select("rid", F.struct(F.col("c.start").alias("start"), F.lit(KINDS.index("id")).alias("rank"), F.col("c.end").alias("end")).alias("span"), F.explode("c.patterns").alias("pattern"))
    more = untried.join(good, "pattern").groupBy("rid").agg(F.collect_set("span").alias("more"))
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "more")))
    return found.drop("found").join(more, "rid", "left").select("doc_id", spans.alias("spans"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = personal_data(base.documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))
    written = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc_id", *map(count, range(4)), F.sha2(written(F.filter("spans", lambda x: x["rank"] < 4)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
