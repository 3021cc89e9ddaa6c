"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only in local mode without one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="packlens-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, for what is dear and used more than once."""
    path = f"{shared_dir(df.sparkSession)}/packlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path, in any store that Spark reads, is one file."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a path of any store; none where it does not exist."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(at) if x.isDirectory()) if store.exists(at) else []
