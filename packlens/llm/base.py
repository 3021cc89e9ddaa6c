"""Shared pieces of the training-data operators: text expressions and scratch tables.

A document row is identified by (doc_id, text): rows repeated in full are one document with
several output rows, and rows that share an id but not a text are judged apart.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.sources.scratch import shared_dir

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shingle width and similarity used wherever no contract names others.
SHINGLE_WORDS, SIMILARITY = 5, 0.75


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, for use inside lambdas that would compute it per element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.

    lower() does it for texts whose other characters it would leave alone, which is a byte loop;
    the character table of translate() is only for the rest.
    """
    rest = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(rest) == rest, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(text: Column) -> Column:
    """64 bits that stand for (doc_id, text) where a whole text would be shuffled as a key."""
    return F.xxhash64(F.col("doc_id"), text)


def row_key2(text: Column) -> Column:
    """64 bits more, for where rows must not be mistaken for each other."""
    return F.xxhash64(F.lit(0x5851F42D4C957F2D), text, F.col("doc_id"))


# --- scratch tables in the folder that the cluster shares


_written: list[tuple[SparkSession, str]] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and a lost executor costs a reread.

    The write's shuffle files go as it ends. The tables of a session are deleted by release() or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/packlens/{uuid.uuid4().hex}/{name}"
    with conf(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept = path  # for forget()
    return kept


@contextlib.contextmanager
def conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Keys that are sent to all executors at most, 8 bytes each and their table's overhead.
BROADCAST_KEYS = 1 << 21


def only_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """df's rows with a key in keys (distinct, a long); not filtered at all where the keys are too many to broadcast.

    It goes before a join on the key, so that other rows' texts are not shuffled.
    """
    return df.join(F.broadcast(keys), name, "left_semi") if keys.count() <= BROADCAST_KEYS else df


def forget(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more, before the session ends."""
    for t in tables:
        own, path = next(x for x in _written if x[0] is t.sparkSession and getattr(t, "_kept", None) == x[1])
        delete(own, path)


def delete(own: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        at = own.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        at.getFileSystem(own.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove((own, path))


def release(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables (of one session)."""
    for own, path in [x for x in _written if spark is None or x[0] is spark]:
        delete(own, path)


atexit.register(release)
