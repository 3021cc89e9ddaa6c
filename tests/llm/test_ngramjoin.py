import random

import pytest

from packlens.llm import ngramjoin, shinglesets
from tests.llm import brute
from tests.llm.test_neardup import SCHEMA, near_copies


def check(spark, rows, percent=80):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = ngramjoin.ngram_join(df, percent).collect()
    want = brute.near_duplicates(rows, percent)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(((d, *want[d, t]) for d, t in rows), key=key)


def test_edge_rows(spark):
    text = "one Two three four five six seven eight nine ten"
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A b"), (6, text), (7, text), (7, text), (None, text.upper()), (None, "alone here"), (8, text + " eleven"), (9, "é" * 50), (6, "another text under a used id here"), (10, "x" * 1_200_000 + " y"), (11, "p q r s t u v " * 20_000), (12, "p q r s t u v " * 20_001)])


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("groups,copies,percent", [(30, 4, 80), (1, 120, 80), (3, 40, 75), (4, 30, 90)])
def test_near_copies(spark, groups, copies, percent):
    check(spark, near_copies(groups, groups, copies), percent)


def test_one_edit_in_each_copy(spark):
    """Copies with one word changed: most share size and prefix, and make a large group."""
    r = random.Random(3)
    one = ["".join(r.choices("abcdefghij", k=4)) for _ in range(90)]
    rows = []
    for i in range(100):
        own = list(one)
        own[r.randrange(90)] = f"own{i}"
        rows.append((i, " ".join(own)))
    check(spark, rows)
    check(spark, rows, 90)


def test_passage_shared_by_many(spark):
    r = random.Random(5)
    passage = " ".join("".join(r.choices("klmnop", k=5)) for _ in range(60))
    check(spark, [(i, " ".join("".join(r.choices("abcdef", k=5)) for _ in range(r.choice([2, 6, 10, 15, 20, 60]))) + " " + passage) for i in range(80)])


def test_at_the_bound(spark):
    """Similarities of exactly 80 in 100 link, one shingle less does not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:84])), (2, " ".join(words[:68])), (3, " ".join(words[100:184])), (4, " ".join(words[100:167]))]
    check(spark, rows)


def test_many_blocks(spark, monkeypatch):
    """Members of an unsettled cluster, compared in blocks, give what one block gives."""
    monkeypatch.setattr(shinglesets.across, "__defaults__", (200,))
    check(spark, near_copies(2, 1, 90))


def test_first_filter_keeps_every_pair():
    for n in range(1, 400):
        for m in range(n, 400):
            if 100 * n >= 80 * m:
                o = shinglesets.least_overlap(m, 80)
                k = 1 + n // ngramjoin.STEP
                if k <= o:  # prefixes of size - overlap + k share k
                    assert ngramjoin.first_prefix(n, 80) >= min(n, n - o + k) and ngramjoin.first_prefix(m, 80) >= min(m, m - o + k)
                assert 1 + shinglesets.least_overlap(m, 80) // ngramjoin.STEP <= k
