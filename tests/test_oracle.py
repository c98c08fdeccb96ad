"""Every registered query against its SQL in DuckDB, on the small tables."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from granary.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating, decimal.Decimal, int, np.integer)):
        return round(float(v), 6)
    if isinstance(v, (pd.Timestamp, datetime.date)):
        return pd.Timestamp(v).isoformat()
    return v


def rows(frame: pd.DataFrame) -> list:
    return sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue._parts[0].queries | catalogue.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalogue.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = df.select(*cols).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = con.execute(sql).df()
    assert sorted(want.columns) == cols
    assert rows(got) == rows(want[cols])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
