"""Every named query with SQL gives the rows that DuckDB gives on the same files."""

import os

import __spark_entry__
import duckdb
import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
OWN = [k for k in __spark_entry__.queries() if not (k[:2] == "op" and k[2].isdigit()) and k != "pipeline"]


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or not isinstance(x, (list, tuple)) and pd.isna(x):
            return ""
        return f"{float(x):.9g}" if type(x).__name__.startswith(("int", "float")) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    got = __spark_entry__.queries()[name](spark, DATA).toPandas()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(got)
    else:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
