"""Every query of the library against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from foliant.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer orders lineitem part events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    plain = [[None if pd.isna(x) else round(float(x), 5) + 0.0 if isinstance(x, float) else x for x in r] for r in df.astype(object).itertuples(index=False, name=None)]
    return sorted(map(repr, plain))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


#: Queries that SQL cannot express; test_operators.py holds them against hand-made cases.
NO_SQL = {"reading_order", "reading_columns", "det_boxes"}


def test_all_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:
        if "f" in (got[c].dtype.kind, want[c].dtype.kind):  # pandas turns whole numbers with nulls into floats
            got[c], want[c] = (pd.Series([None if pd.isna(x) else float(x) for x in df[c]], dtype=object) for df in (got, want))
    assert rows(got) == rows(want)
