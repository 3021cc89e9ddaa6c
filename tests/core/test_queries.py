"""Every registered query of the engine against its SQL on the smallest test tables, and the entry point."""

import glob
import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

from packlens.plans import register

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("set TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        made.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return made


def clean(v):
    if pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, Number) and not isinstance(v, bool) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(clean, r)) for r in df[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(register.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = register.QUERIES[name](spark, DATA).toPandas(), con.execute(register.ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(register.QUERIES) <= set(__spark_entry__.queries()) and set(register.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
