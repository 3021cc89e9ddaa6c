"""Inserted, changed and removed rows of stored tables, as DataFrames to write over or beside the old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def removed(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """table without the rows whose keys are in gone; rows without a key stay."""
    return table.join(gone.select(*keys), list(keys), "left_anti").select(*table.columns)


def updated(table: DataFrame, changes: DataFrame, *keys: str) -> DataFrame:
    """table with the columns of changes in rows with the same keys, null where changes say null; other keys of changes add nothing.

    changes: one row a key at most.
    """
    fresh = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, F.struct(*fresh).alias("__new"))
    df = table.join(new, list(keys), "left")
    return df.select(*[F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in table.columns])


def upserted(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """table with whole rows put in, in place of those with the same keys; columns that rows lack are null."""
    return removed(table, rows, *keys).unionByName(rows, allowMissingColumns=True).select(*table.columns)
