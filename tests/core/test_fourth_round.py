"""Garbled copies: hashed and edited many at once, in numpy, the same texts as by plain Python."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packlens.functions import garble, hashes
from packlens.plans import register
from tests.core.test_training import plain

DATA = "/root/testdata/sf0.001"


def test_no_copy_is_edited_by_the_interpreter(spark):
    """Each copy's edits were a fold over its text, 30 to 50 microseconds of CPU a copy."""
    shown = register.QUERIES["garbled_lines"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in shown and shown.count("MapInArrow") == 1 and shown.count("ArrowEvalPython") == 1, shown


def test_hashes_are_those_of_md5(monkeypatch):
    heads = [*(bytes(range(k)) for k in range(140)), "é₹".encode(), b"same", b"same"]
    for tails in ([b":1:1", b":15:4", b":100:12"], [b""], [b"x" * 55, b""], [b"x" * 60]):
        want = [[hashlib.md5(h + t).digest() for t in tails] for h in heads]
        for rows in (1, 2, 16384):
            monkeypatch.setattr(hashes, "ROWS", rows)
            assert [[d.astype("<u4").tobytes() for d in row] for row in hashes.md5(heads, tails)] == want
    assert hashes.md5([], [b"x"]).shape == (0, 1, 4) and hashes.md5([b"x"], []).shape == (1, 0, 4)


ODD = "aAeEmMrnvwd .,:-0O1lI 5sS\x00\n$" * 2 + "éüßØÅİıſ₹ﬃŉ日本\U0001f600ΣσςﬀǅＡａK"


def odd_texts():
    rnd = random.Random(4)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.choice([0, 1, 2, 3, 9, 10, 20, 30, 60]))) for _ in range(300)]
    return [*made, None, "", "rn" * 30, "vv" * 9, " " * 40, "ﬃ" * 30, "x" * 5000, "日" * 700]


@pytest.mark.parametrize(("rows", "codes"), [(8192, 1 << 20), (7, 1 << 20), (8192, 600)])
def test_edits_are_those_of_plain_python(monkeypatch, rows, codes):
    monkeypatch.setattr(garble, "ROWS", rows)
    monkeypatch.setattr(garble, "CODES", codes)
    texts, n = odd_texts(), 5
    edits = [max(1, min(4, len(t or "") // 10 + 1)) for t in texts]
    digests = [b"".join(hashlib.md5(f"9:{i}:{c}:{e}".encode()).digest() for c in range(1, n + 1) for e in range(1, k + 1)) for i, k in enumerate(edits)]
    got = {(int(i), int(c)): x for of, copy, made in garble._garbled(pa.array(texts, pa.string()), pa.array(digests, pa.binary()), n) for i, c, x in zip(of, copy, made.to_pylist(), strict=True)}
    assert got == {(i, c): plain(t, f"{i}:{c}", 9, 1.2) for i, t in enumerate(texts) for c in range(1, n + 1)}


def test_many_alphabets_have_wider_codes():
    texts = ["".join(map(chr, range(0x4E00 + 300 * i, 0x4E00 + 300 * i + 300))) + "rn" for i in range(60)]
    digests = [b"".join(hashlib.md5(f"9:{i}:{c}:{e}".encode()).digest() for c in (1, 2) for e in (1, 2, 3, 4)) for i in range(60)]
    got = {(int(i), int(c)): x for of, copy, made in garble._garbled(pa.array(texts), pa.array(digests), 2) for i, c, x in zip(of, copy, made.to_pylist(), strict=True)}
    assert got == {(i, c): plain(t, f"{i}:{c}", 9, 1.2) for i, t in enumerate(texts) for c in (1, 2)}


def test_copies_keep_other_columns_and_odd_keys(spark):
    rows = [(None, "MRP Rs. 42.00", [1], 1.5), ("k" * 80, "Net Qty: 250 g", None, None), ("é", None, [], 0.0), ("", "", [2, None], 2.0), ("k" * 80, "Net Qty: 250 g", [7], 0.5)]
    df = spark.createDataFrame(rows, "id string, text string, more array<int>, x double")
    key = lambda k, c: str(c) if k is None else f"{k}:{c}"
    want = sorted(((k, t if c == 0 else plain(t, key(k, c), 123, 1.2), m, x, c) for k, t, m, x in rows for c in range(4)), key=str)
    got = garble.copies(df, n=3)
    assert got.columns == ["id", "text", "more", "x", "copy"] and sorted(map(tuple, got.collect()), key=str) == want
    assert sorted(map(tuple, garble.copies(df, n=0).collect()), key=str) == sorted(((*r, 0) for r in rows), key=str)
    by_number = garble.copies(df.select(F.lit(7).cast("long").alias("no"), F.lit("keep").alias("copy"), "text").limit(1), "no", n=2).collect()
    assert [(r.no, r.copy, r.text) for r in sorted(by_number, key=lambda r: r.copy)] == [(7, c, rows[0][1] if c == 0 else plain(rows[0][1], f"7:{c}", 123, 1.2)) for c in range(3)]
