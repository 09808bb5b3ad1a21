"""Every registered query at sf0.001 against its SQL twin; queries without one are run."""

import duckdb
import pandas as pd
import pytest

from lintlake.plans import register
from lintlake.plans.base import TABLES

SF = "/root/testdata/sf0.001"
QUERIES, TWINS = register.queries(), register.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, float):
        return str(int(x)) if x == int(x) else repr(round(x, 6))
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return "[" + ",".join(map(cell, x)) + "]"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].replace("T00:00:00", "")
    return str(x)


def rows(df: pd.DataFrame) -> list:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in TWINS:
        want = duck.sql(TWINS[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
