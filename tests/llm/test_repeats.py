import random

from packlens.llm import repeats

SCHEMA = "doc_id long, text string, rid string, gone int"


def brute(rows, depth=50):
    holders = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - depth + 1):
            k = b[i : i + depth]
            holders[k] = min(holders.get(k, (True, 0)), (d is None, d or 0))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if holders[b[i : i + depth]] < (d is None, d or 0):
                gone[i : i + depth] = b"\1" * depth
        spans = [i for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1])]
        out.append((d, len(b), sum(gone), len(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(3)
    got = repeats.remove_repeats(df).collect()
    found = sorted(((r.doc_id, r.n_bytes, sum(r.ends) - sum(r.starts), len(r.starts), bytes(r.kept)) for r in got), key=str)
    assert found == brute(rows)


def test_edge_rows(spark):
    same = "abcdefghij" * 6
    check(spark, [(1, None), (2, ""), (3, "short"), (4, same), (5, same), (5, same), (5, same + "x"), (None, same), (None, "only here, but long enough for a window of fifty bytes"), (6, "é" * 40), (7, "zé" + "é" * 40), (8, "a" * 300), (9, "a" * 200)])
    check(spark, [])


def test_passages(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(r.randrange(5, 40))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = []
        for _ in range(r.randrange(1, 6)):
            p = r.choice(passages)
            a, b = sorted(r.choices(range(len(p) + 1), k=2))
            parts += [p[a:b], " ".join(word() for _ in range(r.randrange(12)))]
        rows.append((i * 37 % 101, " ".join(parts)))
    check(spark, rows)


def test_text_longer_than_a_segment(spark):
    r = random.Random(2)
    text = "".join(r.choices("abcdefgh ", k=1_060_000))
    rows = [(1, text), (2, "0" * 777 + text), (3, text[1_048_000:1_049_200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.starts, x.ends) for x in repeats.remove_repeats(df).collect()}
    assert got == {1: ([], []), 2: ([777], [777 + len(text)]), 3: ([0], [1200])}
