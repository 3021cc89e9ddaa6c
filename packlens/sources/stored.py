"""Stored tables that change: versions, switched at once, of Parquet rows in buckets of their keys.

    path/data/<folder>/bucket=<k>/    rows, never changed once written
    path/versions/<number>            which folders hold each bucket

A change writes new folders for the buckets that it touches, then the next version's file, which must not
exist yet. A reader sees the last version that was written whole. What fails before that leaves the table as
it was; of two writers at once the second fails and may try again. A change reads and rewrites only the
buckets of its keys; inserts read none but to see whether a key is there already.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packlens.operators import constraints
from packlens.sources import changes


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to make."""


class Rejected(ValueError):
    """Rows break the table's rules; nothing was written."""


class Store:
    """Small files in any store that Spark writes, by its own file system classes."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(folder))) if self.fs.exists(self.at(folder)) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, written beside its name and then put there; Conflict if the name is taken."""
        beside = self.at(f".new-{uuid.uuid4().hex}")
        stream = self.fs.create(beside, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self.at(name).getParent())
        taken = self.fs.exists(self.at(name))
        if taken or not self.fs.rename(beside, self.at(name)):
            self.fs.delete(beside, False)
            raise Conflict(name)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class StoredTable:
    """A table of rows with a key (columns together unique, none null), and rules that its rows must keep."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, *keys: str, rules: list[constraints.Rule] = (), buckets: int = 64):
        self.spark, self.path, self.keys, self.rules, self.buckets = spark, path.rstrip("/"), list(keys), list(rules), buckets
        self.schema = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
        self.store = Store(spark, path)

    # --- reading

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.store.names("versions") if n.isdigit())

    def folders(self, version: int | None = None) -> dict[int, list[str]]:
        """Folders of each bucket, at the last version or another."""
        known = self.versions()
        if not known or version is not None and version not in known:
            raise ValueError(f"no version {version or 'at all'}")
        return {int(k): v for k, v in json.loads(self.store.text(f"versions/{(version or known[-1]):020d}")).items()}

    def read(self, version: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Rows at a version, of all buckets or some."""
        at = self.folders(version) if version is not None or self.versions() else {}
        paths = [f"{self.path}/data/{f}/bucket={k}" for k, fs in sorted(at.items()) if buckets is None or k in buckets for f in fs]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # --- writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), self.buckets).cast("int")

    def touched(self, rows: DataFrame) -> set[int]:
        """Buckets of rows' keys: at most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect()}

    def put(self, rows: DataFrame) -> dict[int, str]:
        """Rows written to a new folder; its buckets. Not seen by readers yet."""
        folder = uuid.uuid4().hex
        own = rows.select(*self.schema.names).withColumn("bucket", self.bucket())
        own.repartition("bucket", F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return {int(n[7:]): folder for n in self.store.names(f"data/{folder}") if n.startswith("bucket=")}

    @contextlib.contextmanager
    def checked(self, rows: DataFrame) -> Iterator[DataFrame]:
        """rows as the rules want them, evaluated once and written to the side for the block; Rejected if one breaks a rule, has no key, or two share one."""
        aside = f"staged/{uuid.uuid4().hex}"
        try:
            df = constraints.evaluated(rows, self.rules)
            have = [c if c in df.columns else F.lit(None).cast(self.schema[c].dataType).alias(c) for c in self.schema.names]
            df.select(*have, "broken").write.parquet(f"{self.path}/{aside}")
            df = self.spark.read.schema(T.StructType([*self.schema.fields, df.schema["broken"]])).parquet(f"{self.path}/{aside}")
            bad = df.where(F.size("broken") > 0)
            if not bad.isEmpty():
                raise Rejected("; ".join(f"{r.column}: {r.broken} ({r['count']})" for r in constraints.reasons(bad).limit(10).collect()))
            if not df.where(" or ".join(f"{k} is null" for k in self.keys)).isEmpty() or not df.groupBy(*self.keys).count().where("count > 1").isEmpty():
                raise Rejected("keys must be there and differ")
            yield df.drop("broken")
        finally:
            self.store.delete(aside)

    def switched(self, before: int, folders: dict[int, list[str]]) -> int:
        """The version after `before`, once its file is there."""
        self.store.create(f"versions/{before + 1:020d}", json.dumps({str(k): v for k, v in sorted(folders.items())}))
        return before + 1

    def now(self) -> tuple[int, dict[int, list[str]]]:
        last = (self.versions() or [0])[-1]
        return last, self.folders(last) if last else {}

    def changed(self, touched: set[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """The next version: the touched buckets' rows as change makes them, all others as they are."""
        last, at = self.now()
        new = self.put(change(self.read(last or None, touched))) if touched else {}
        return self.switched(last, {k: v for k, v in at.items() if k not in touched} | {k: [f] for k, f in new.items()})

    def insert(self, rows: DataFrame) -> int:
        """New rows, kept to the rules; keys that are there already are refused. Old rows are not written again."""
        with self.checked(rows) as good:
            last, at = self.now()
            there = self.read(last or None, self.touched(good))
            if not there.select(*self.keys).join(good, self.keys, "left_semi").isEmpty():
                raise Rejected("a key is there already")
            for k, folder in self.put(good).items():
                at[k] = [*at.get(k, []), folder]
            return self.switched(last, at)

    def update(self, rows: DataFrame) -> int:
        """Columns of rows (keys and what changes) put in place of those with the same keys, kept to the rules; other keys add nothing."""

        def change(old: DataFrame) -> DataFrame:
            return changes.updated(old, rows, *self.keys).join(rows.select(*self.keys), self.keys, "left_semi")

        touched = self.touched(rows)
        with self.checked(change(self.read(buckets=touched))) as good:
            return self.changed(touched, lambda old: changes.upserted(old, good, *self.keys))

    def upsert(self, rows: DataFrame) -> int:
        """Whole rows put in, in place of those with the same keys."""
        with self.checked(rows) as good:
            return self.changed(self.touched(good), lambda old: changes.upserted(old, good, *self.keys))

    def delete(self, gone: DataFrame) -> int:
        """The rows of these keys taken out."""
        return self.changed(self.touched(gone), lambda old: changes.removed(old, gone, *self.keys))

    def reseed(self, rows: DataFrame) -> int:
        """All rows replaced at once."""
        with self.checked(rows) as good:
            return self.switched(self.now()[0], {k: [f] for k, f in self.put(good).items()})

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions but the last ones, and folders that none of these names; returns how many folders went. Run it while nobody writes."""
        known = self.versions()
        for v in known[: -keep or None] if keep else known:
            self.store.delete(f"versions/{v:020d}")
        used = {f for v in self.versions() for fs in self.folders(v).values() for f in fs}
        gone = [f for f in self.store.names("data") if f not in used]
        for f in gone:
            self.store.delete(f"data/{f}")
        return len(gone)
