import random

from packlens.llm import decontam
from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string, n_item int", "item_id long, text string, lang string"


def want(docs, items):
    out = []
    for d, t in docs:
        for i, q in items:
            words = len(brute.WORD.findall(q or ""))
            own, s = brute.shingles(q), brute.shingles(t, min(5, max(words, 1)))
            n = len(own & s)
            if own and 4 * n >= 3 * len(own):
                out.append((d, i, len(own), n))
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "en") for i, t in items], ITEMS)
    return sorted(((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontam.contained(a, b, **more).collect()), key=str)


def test_edge_rows(spark):
    items = [(1, "The quick brown fox jumps over it"), (1, "the quick brown fox jumps over it"), (2, "short one"), (3, None), (4, ""), (None, "alpha beta gamma delta epsilon zeta")]
    docs = [(1, "see THE quick brown fox jumps over it now"), (1, "see the quick brown fox jumps over it now"), (2, None), (3, ""), (4, "a short ONE"), (4, "a short ONE"), (None, "x alpha beta gamma delta epsilon zeta"), (5, "short")]
    assert run(spark, docs, items) == want(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_parts_of_items_in_long_texts_over_blocks(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefgh", k=4))
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(40)]
    docs = []
    for i in range(60):
        w = items[i % 40][1].split()
        part = w[: max(1, round(len(w) * r.choice([0.5, 0.8, 0.9, 1])))]
        docs.append((i, " ".join([word() for _ in range(r.randrange(3000))] + part + [word() for _ in range(5)])))
    found = want(docs, items)
    assert found and run(spark, docs, items) == found == run(spark, docs, items, block_bytes=1000)
