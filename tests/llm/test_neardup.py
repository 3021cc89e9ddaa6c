import random

import pytest
from pyspark.sql import functions as F

from packlens.llm import base, neardup, shinglesets
from tests.llm import brute

SCHEMA = "doc_id long, text string, rid string, c int"


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = neardup.near_duplicates(df).collect()
    want = brute.near_duplicates(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=key) == sorted(((d, *want[d, t], d == want[d, t][1]) for d, t in rows), key=key)


def test_edge_rows(spark):
    text = "one Two three four five six seven eight nine ten"
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A b"), (6, text), (7, text), (7, text), (None, text.upper()), (None, "alone here"), (8, text + " eleven"), (9, "é" * 50), (6, "another text under a used id here")])


def test_empty_table(spark):
    check(spark, [])


def near_copies(seed, groups, copies):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=4)) for _ in range(500)]
    rows = []
    for _ in range(groups):
        one = r.choices(words, k=r.choice([6, 12, 30, 80, 300]))
        for _ in range(copies):
            own = list(one)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append((len(rows) * 7 % 10007, " ".join(own)))
    return rows


@pytest.mark.parametrize("groups,copies", [(30, 4), (1, 120), (3, 40)])
def test_near_copies(spark, groups, copies):
    check(spark, near_copies(groups, groups, copies))


def test_passage_shared_by_many(spark):
    r = random.Random(5)
    passage = " ".join("".join(r.choices("klmnop", k=5)) for _ in range(60))
    rows = [(i, " ".join("".join(r.choices("abcdef", k=5)) for _ in range(r.choice([2, 10, 15, 20, 25, 60]))) + " " + passage) for i in range(80)]
    check(spark, rows)


def test_long_word_and_long_text(spark):
    check(spark, [(1, "x" * 1_200_000 + " y"), (2, "X" * 1_200_000 + " y"), (3, "p q r s t u v " * 20_000), (4, "p q r s t u v " * 20_001)])


def test_clusters_compared_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(shinglesets, "SPLIT_SHINGLES", 64)
    check(spark, near_copies(2, 1, 90))


def test_rows_that_share_64_bits(spark, monkeypatch):
    """With one row key for all rows, classes get their own sets and each group keeps its own row."""
    monkeypatch.setattr(base, "row_key", lambda text: F.lit(7).cast("long"))
    rows = [*near_copies(6, 8, 3), (20_000, ""), (20_001, " "), (20_002, None), (20_003, "alone")]
    check(spark, rows)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    want = brute.near_duplicates(rows)
    got = sorted(r.doc_id for r in neardup.representatives(df).collect())
    assert got == sorted(d for d, t in rows if want[d, t][1] == d) and len(got) >= 12
