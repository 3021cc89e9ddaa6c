import math
import random
from fractions import Fraction

import numpy as np
import pytest

from packlens.llm import whiten

SCHEMA = "vec_id long, embedding array<double>, label int, n string"


def exact(rows):
    """Remaining rows as whole vectors, n, sums, and the covariance in fractions."""
    left = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in left), default=0)
    left = [(i, x + [0] * (d - len(x))) for i, x in left]
    fit = [list(x) for x in {tuple(x) for _, x in left}]
    n, s = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    mean = [Fraction(v, n) for v in s]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(d)] for i in range(d)]
    return left, n, s, cov


def check(spark, rows, components=4):
    got = whiten.whitened(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA), components).collect()
    left, n, s, cov = exact(rows)
    values, vectors = np.linalg.eigh(np.array(cov, float))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(s))
    assert len(got) == k * len(left)
    want = sorted(((i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))) for i, x in left for _ in range(k)), key=str)
    assert sorted(((r.vec_id, int(r.deviation)) for r in got), key=str) == want
    trace = float(sum(cov[i][i] for i in range(len(s))))
    for j in range(k):
        own = [r for r in got if r.component == j + 1]
        if values[j] <= 1e-13 * trace:
            assert all(r.whitened is None and r.explained == 0 for r in own)
            continue
        assert all(r.n == n and abs(r.explained - values[j] / trace) < 1e-9 and r.identity_error < 1e-9 for r in own)
        want = sorted(float(np.array([a - b / n for a, b in zip(x, s, strict=True)]) @ vectors[:, j] / math.sqrt(values[j])) for _, x in left)
        own = sorted(r.whitened for r in own)
        assert np.allclose(own, want, atol=1e-8) or np.allclose(own, sorted(-w for w in want), atol=1e-8)


def vectors(seed, n, d, scale=1.0):
    r = random.Random(seed)
    return [(i, [scale * (j + 1) * r.gauss(0.1, 1) for j in range(d)]) for i in range(n)]


def test_random(spark):
    check(spark, vectors(1, 200, 6))


def test_few_dimensions_and_repeated_rows(spark):
    rows = vectors(2, 30, 3)
    check(spark, rows + rows[:10] + [rows[0]] * 300 + [(None, rows[3][1])])


def test_bad_and_ragged_vectors(spark):
    rows = vectors(3, 20, 5)
    rows += [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf")] + [0.0] * 4), (94, []), (95, [1.5, -2.5])]
    check(spark, rows)


def test_no_variance(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    check(spark, [(1, [1.0, 2.0, 0.0]), (2, [2.0, 2.0, 0.0])])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])]])
def test_empty_tables(spark, rows):
    assert whiten.whitened(spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)).collect() == []


def test_large_numbers(spark):
    check(spark, vectors(4, 40, 4, 1e9))
    check(spark, vectors(5, 12, 3, 3e13))


def test_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0], 1, "x"), (2, [-1e300, 1.0], 1, "x"), (3, [1e17, 3.0], 1, "x")], SCHEMA)
    got = whiten.whitened(df).collect()
    assert len(got) == 6 and all(r.identity_error < 1e-6 for r in got)


@pytest.mark.parametrize("bits", [3, 15, 16, 31, 40, 60, 90])
def test_digit_products(bits):
    r = random.Random(bits)
    y = np.array([[r.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(33)], np.int64 if bits < 62 else object)
    plain = y.astype(object)
    assert (whiten.gram(y) == plain.T.dot(plain)).all()
    assert whiten.squares(y).tolist() == (plain * plain).sum(axis=1).tolist()
    assert all(abs(x).max() <= 1 << 15 for x in whiten.digits(y))
