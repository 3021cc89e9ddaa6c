"""Whitening of embeddings by an exact covariance (operator 13).

Vectors become whole numbers. Their sums, and the products of the centred numbers n * x - S, are taken by
digit slices: whole numbers are cut into signed 16-bit digits, the digits' products are float64 BLAS
products of at most 2**22 rows, so that every sum stays below 2**53 and is exact, and the slices are put
together as big integers. Tasks' matrices are merged row by row in Spark; only the d x d result, whose size
is the dimension's, comes to the driver, which rounds it once and takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base

COMPONENTS, SCALE = 4, 256
#: Bits of a digit; numbers of a block that is multiplied at once.
DIGIT, BLOCK = 16, 1 << 20
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def digits(y: np.ndarray) -> list[np.ndarray]:
    """Signed base-2**DIGIT digits of whole numbers, lowest first, as float64 within +-2**(DIGIT - 1)."""
    out, half, mask = [], 1 << (DIGIT - 1), (1 << DIGIT) - 1
    while True:
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
        if not np.any(y):
            return out


def recombined(slices: dict[int, np.ndarray]) -> np.ndarray:
    """Big integers from sums of float64 digit products by digit place."""
    return sum(x.astype(np.int64).astype(object) * (1 << (DIGIT * k)) for k, x in slices.items())


def gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers as big integers."""
    own, slices = digits(y), {}
    for i, a in enumerate(own):
        for j, b in enumerate(own[i:], i):
            product = a.T @ b
            slices[i + j] = slices.get(i + j, 0) + (product if i == j else product + product.T)
    return recombined(slices)


def squares(y: np.ndarray) -> np.ndarray:
    """Each row's sum of squares: longs where all fit, else big integers."""
    own, slices = digits(y), {}
    for i, a in enumerate(own):
        for j, b in enumerate(own[i:], i):
            slices[i + j] = slices.get(i + j, 0) + np.einsum("ij,ij->i", a, b) * (1 if i == j else 2)
    if (y.astype(np.float64) ** 2).sum(axis=1).max(initial=0) < 4e18:
        return sum(x.astype(np.int64) << (DIGIT * k) for k, x in slices.items() if DIGIT * k < 64)
    return recombined(slices)


def sums(x: np.ndarray) -> list[int]:
    return recombined({k: a.sum(axis=0) for k, a in enumerate(digits(wide(x, 1)))}).tolist()


def wide(x: np.ndarray, times: int) -> np.ndarray:
    """x as longs if `times` its largest number is far from a long's bounds, else as big integers."""
    return x if times * max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) < 1 << 61 else x.astype(object)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n * x - s."""
    x = wide(x, 2 * n)
    big = x.dtype == object or max(map(abs, s)) >= 1 << 61
    return (x.astype(object) if big else x) * n - np.array(s, object if big else np.int64)


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, their vectors as a matrix) in blocks of bounded size."""
    rows = max(1, BLOCK // d)
    for batch in batches:
        for i in range(0, len(batch), rows):
            part = batch.slice(i, rows)
            yield part, part.column("x").flatten().to_numpy().reshape(-1, d)


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of vectors without nulls and non-finite entries, x as longs (at a long's bounds beyond them)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    vector = F.col("embedding").cast("array<double>")
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("e")).where(F.col("e").isNotNull() & F.forall("e", finite))
    return good.select("vec_id", F.transform("e", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long")).alias("x"))


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, x in blocks(batches, d):
            n, total = n + len(x), [a + b for a, b in zip(total, sums(x), strict=True)]
        yield pa.record_batch([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], names=["i", "total"])

    found = dict(fit.mapInArrow(of, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect())
    return int(found.get(-1) or 0), [int(found.get(i) or 0) for i in range(d)]


def products(fit: DataFrame, d: int, n: int, s: list[int]) -> np.ndarray:
    """Sum of (n * x - s)(n * x - s).T over all vectors, exact."""

    def put(rows: Iterator[tuple[int, list[int]]]) -> pa.RecordBatch:
        rows = list(rows)
        coded = [[v.to_bytes(v.bit_length() // 8 + 1, "little", signed=True) for v in map(int, r)] for _, r in rows]
        return pa.record_batch([pa.array([i for i, _ in rows], pa.int32()), pa.array(coded, pa.list_(pa.binary()))], names=["i", "line"])

    def got(line: list[bytes]) -> np.ndarray:
        return np.array([int.from_bytes(v, "little", signed=True) for v in line], object)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in blocks(batches, d):
            one = gram(centred(x, n, s))
            total = one if total is None else total + one
        if total is not None:
            yield put(enumerate(total.tolist()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line = None, None
        for batch in batches:
            out = []
            for i, x in zip(batch.column("i").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if i == now:
                    line = line + got(x)
                else:
                    out += [] if now is None else [(now, line)]
                    now, line = i, got(x)
            yield put(out)
        yield put([] if now is None else [(now, line)])

    schema = "i int, line array<binary>"
    lines = fit.mapInArrow(of, schema).repartition("i").sortWithinPartitions("i").mapInArrow(merged, schema).collect()
    return np.array([[int.from_bytes(v, "little", signed=True) for v in r.line] for r in sorted(lines)], object)


def eigen(total: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns, parts of the trace) of total / n**3, the largest k; each vector's largest entry is positive."""
    v = np.array([[a / n**3 for a in row] for row in total.tolist()], np.float64)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    trace = sum(total[i][i] for i in range(len(total))) / n**3
    # what is only rounding isn't a component
    real = values > len(v) * np.finfo(float).eps * max(trace, 0.0)
    return np.where(real, values, 0.0), vectors * signs, np.where(real, values / (trace or 1.0), 0.0)


def identity_error(fit: DataFrame, d: int, n: int, s: list[int], axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = axes.shape[1]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for _, x in blocks(batches, d):
            w = centred(x, n, s).astype(np.float64) / n @ axes
            total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "total"])

    found = dict(fit.mapInArrow(of, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect())
    means, seconds = np.array([found[i] for i in range(k)]) / n, np.array([found[i] for i in range(k, k + k * k)]).reshape(k, k) / n
    return float(np.abs(seconds - np.outer(means, means) - np.eye(k)).max(initial=0))


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """For each vector (vec_id, embedding) and each of the leading components: vec_id, component (from 1),
    n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds null or non-finite entries are dropped. An entry becomes
    floor(256 * entry), a long, at a long's bounds beyond them. Vectors shorter than the longest count as
    filled up with zeros; without any entry in the table there are no components and so no rows. The
    covariance is over distinct vectors, so repeated rows have no weight, but each row has its results;
    null ids are carried. deviation is null where 38 digits don't hold it. Components without variance
    have a null whitened and explain 0; ties between eigenvalues are broken by the solver, alike for all
    rows. Empty tables give no rows; other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows = whole_vectors(embeddings)
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if d == 0:
        return spark.createDataFrame([], RESULT)
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))))
    fit = base.keep(rows.select("x").distinct(), "fit")
    n, s = column_sums(fit, d)
    values, vectors, explained = eigen(products(fit, d, n, s), n, components)
    real = values > 0
    axes = vectors / np.sqrt(np.where(real, values, 1.0))
    error = identity_error(fit, d, n, s, axes[:, real])
    k = len(values)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, d):
            y = centred(x, n, s)
            square = squares(y)
            exact = pa.array(square) if square.dtype != object else pa.array([Decimal(v) if abs(v) < 10**38 else None for v in square], pa.decimal128(38, 0))
            w = y.astype(np.float64) / n @ axes
            at, m = np.repeat(np.arange(len(x)), k), len(x)
            yield pa.record_batch(
                [
                    part.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    exact.cast(pa.decimal128(38, 0)).take(pa.array(at)),
                    pa.array(w.ravel(), mask=np.tile(~real, m)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(of, RESULT)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where a long doesn't hold it."""
    found = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))
