"""Documents to a training mix: quality rules, line dedup, near-duplicates, decontamination, source mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packlens.llm import base, decontam, linededup, mixing, neardup, quality


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their hosts' verdicts keep."""
    return quality.good_documents(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines found in many documents; n_chars is that of the text left."""
    df = linededup.line_dedup(docs)
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.representatives(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.fair_mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality_rules", good_documents), ("line_dedup", distinct_lines), ("near_dedup", one_of_each), ("decontaminate", uncontaminated), ("source_mix", mix)]
#: Near-duplicate components are beyond plain SQL at this size; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = base.keep(stage(spark, docs, sf_dir), name)
    return docs
