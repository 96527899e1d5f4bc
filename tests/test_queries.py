"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from signalloom.plans import candidates  # noqa: F401
from signalloom.plans.review import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return ""
        if hasattr(x, "year"):
            return str(x)[:10]
        return f"{float(x):.5f}" if not isinstance(x, str) and not isinstance(x, bool) and type(x).__name__ != "bool" else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
