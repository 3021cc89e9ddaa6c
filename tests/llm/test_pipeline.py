import random
from collections import defaultdict

import pytest

from tests.llm import brute, test_quality

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus(seed=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 8))) for _ in range(400)]
    words = lambda n: r.choices(vocabulary, k=n)
    items = [(i, " ".join(words(20))) for i in range(6)]
    common = [" ".join(words(6)) for _ in range(4)]
    rows = []
    for i in range(160):
        kind = i % 8
        lines = [" ".join(words(r.randrange(8, 30))) for _ in range(r.randrange(1, 4))]
        if kind == 1:
            lines = [" ".join(w + r.choice(["###", "%%"]) for w in words(30))]
        elif kind == 2:
            lines = [" ".join(words(5))]
        elif kind == 3 and rows:
            lines = r.choice(rows)[1].split("\n")
            lines[0] = lines[0].replace(" ", "  ", 1)
        elif kind == 4:
            lines.append(items[r.randrange(6)][1] + " " + " ".join(words(10)))
        elif kind == 5:
            lines = [" ".join(words(3)) + " again" * 20]
        if r.random() < 0.4:
            lines.append(r.choice(common))
        rows.append((i, "\n".join(lines), "en", r.choice(["a", "a", "a", "b", "c", None]), 0))
    for i in range(160, 200):  # a host whose documents mostly break an advisory rule, and another's that break it as well
        own = " ".join("".join(r.choices("xyz", k=r.choice([1, 2]))) for _ in range(40)) if i % 5 else " ".join(words(25))
        rows.append((i, own, "en", "poor" if i < 190 else "a", 0))
    return [(d, t, lang, s, len(t)) for d, t, lang, s, _ in rows], items


def brute_run(rows, items):
    good = [row for row, (*_, kept) in zip(rows, test_quality.verdicts([(d, t, s) for d, t, _, s, _ in rows]), strict=True) if kept]
    assert not any(s == "poor" and len(t.split()) == 40 for _, t, _, s, _ in good) and any(s == "a" and len(t.split()) == 40 for _, t, _, s, _ in good)
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\v\f\r").translate(brute.A_Z)
    for row in good:
        for x in row[1].split("\n"):
            holders[key(x)].add(row[0])
    lines = [(d, "\n".join(x for x in t.split("\n") if not (key(x) and len(holders[key(x)]) >= 10)), s) for d, t, _, s, _ in good]
    groups = brute.near_duplicates([(d, t) for d, t, _ in lines])
    one = [(d, t, s) for d, t, s in lines if groups[d, t][1] == d]
    sets = [brute.shingles(q) for _, q in items]
    return [(d, len(brute.WORD.findall(t)), s) for d, t, s in one if not any(4 * len(x & brute.shingles(t)) >= 3 * len(x) for x in sets)]


def test_run_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute_run(rows, items)
    assert sorted((r.doc_id, r.size, r.source) for r in got) == sorted(want, key=lambda x: x[0])
    assert 20 < len(want) < 110
    by_source = defaultdict(lambda: [0, 0.0])
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by_source[r.source][0] += r.taken
        by_source[r.source][1] = r.target
    assert all(abs(a - t) <= 2 * max(r.size for r in got) for a, t in by_source.values())


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows[:30] + [(None, None, None, None, None), rows[3]], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
