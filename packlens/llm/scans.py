"""Running positions, sums and polynomial fingerprints along sorted rows of a key, in numpy.

Rows are ranged by key and order, so that one key may lie in many partitions; each partition is scanned
for itself, and what its first key has had in earlier partitions is added afterwards. Such keys are fewer
than the partitions, so what is added is a small table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.llm import base

#: A fingerprint has two lanes modulo this prime, so that products fit a long.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 69_069_069)
LANES = ("fa", "fb")


def power(lane: int, exponents: np.ndarray) -> np.ndarray:
    """The lane's base to these powers."""
    out, square, left = np.ones(len(exponents), np.int64), BASES[lane], exponents.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square, left = square * square % PRIME, left >> 1
    return out


def scanned(df: DataFrame, key: str, order: list[Column], sums: tuple[str, ...] = (), fingerprint: bool = False) -> DataFrame:
    """df with pos, the row's place within its key from 0, written once; key is a long without nulls.

    Columns in sums (longs) become running sums. With fingerprint, df has the row's hash as lanes fa and
    fb, and these become sum(hash[j] * base ** j) over the rows so far; ga and gb are those before the row.
    Rows equal in key and order may come in any order.
    """
    lanes = LANES if fingerprint else ()
    runs, given = (*sums, *lanes), df.columns
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in (("ga", "gb") if lanes else ()) + ("pos",)], T.StructField("part", T.IntegerType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, count, totals = TaskContext.get().partitionId(), None, 0, dict.fromkeys(runs, 0)
        for batch in batches:
            k = batch.column(key).to_numpy()
            m = len(k)
            if not m:
                continue
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            start = np.repeat(starts, np.diff(np.append(starts, m)))
            first = int(starts[1]) if len(starts) > 1 else m
            going_on = now is not None and now == k[0]
            pos = np.arange(m) - start
            if going_on:
                pos[:first] += count
            columns = {n: batch.column(n) for n in given}
            for name in runs:
                x = batch.column(name).to_numpy().astype(np.int64)
                if name in lanes:
                    x = x * power(lanes.index(name), pos) % PRIME
                run = np.cumsum(x)
                run = run - (run - x)[start]
                if going_on:
                    run[:first] += totals[name]
                if name in lanes:
                    run %= PRIME
                    columns["g" + name[1]] = pa.array((run - x) % PRIME)
                columns[name], totals[name] = pa.array(run), int(run[-1])
            now, count = int(k[-1]), int(pos[-1]) + 1
            columns |= {"pos": pa.array(pos), "part": pa.array(np.full(m, part, np.int32))}
            yield pa.record_batch([columns[f.name] for f in schema.fields], names=[f.name for f in schema.fields])

    salted = df.withColumn("__salt", F.monotonically_increasing_id()).repartitionByRange(key, *order, "__salt").drop("__salt")
    rows = base.keep(salted.sortWithinPartitions(key, *order).mapInArrow(local, schema), "scanned")
    on = base.keep(rows.groupBy(key).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select(key), "spanning")
    ends = rows.join(F.broadcast(on), key).groupBy(key, "part").agg(F.max(F.struct("pos", *runs)).alias("x")).select(key, "part", (F.col("x.pos") + 1).alias("n"), *[f"x.{n}" for n in runs])
    names = ["off", *[f"{n}_0" for n in runs], *[f"{n}_x" for n in lanes]]

    def before(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        out = {key: pdf[key], "part": pdf["part"], "off": pdf["n"].cumsum() - pdf["n"]}
        out |= {f"{n}_0": pdf[n].cumsum() - pdf[n] for n in sums}
        for i, n in enumerate(lanes):
            out[f"{n}_x"] = power(i, out["off"].to_numpy())
            x = pdf[n].to_numpy() * out[f"{n}_x"] % PRIME
            out[f"{n}_0"] = (np.cumsum(x) - x) % PRIME
        return pd.DataFrame(out)[[key, "part", *names]]

    carry = ends.groupBy(key).applyInPandas(before, f"{key} long, part int, " + ", ".join(f"{n} long" for n in names))
    add = lambda n, x="": F.col(n) + F.coalesce(F.col(f"{x or n}_0"), F.lit(0))
    moved = lambda n, x: F.pmod(F.coalesce(F.col(f"{x}_0"), F.lit(0)) + F.col(n) * F.coalesce(F.col(f"{x}_x"), F.lit(1)), F.lit(PRIME))
    new = {n: add(n) for n in sums} | {n: moved(n, n) for n in lanes} | ({"ga": moved("ga", "fa"), "gb": moved("gb", "fb")} if lanes else {}) | {"pos": F.col("pos") + F.coalesce("off", F.lit(0))}
    both = rows.join(F.broadcast(base.keep(carry, "carry")), [key, "part"], "left")
    return both.select(*[new[f.name].alias(f.name) if f.name in new else F.col(f.name) for f in schema.fields if f.name != "part"])
