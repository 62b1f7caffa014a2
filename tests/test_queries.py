"""Every registered query that has SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pandas as pd
import pytest

from tessera.plans.queries import queries
from tessera.plans.sql import oracle_sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def test_every_statement_belongs_to_a_query():
    assert oracle_sql().keys() <= queries().keys()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, sf, duck):
    got = queries()[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    if name not in oracle_sql():
        assert got.count() > 0
        return
    want = duck.sql(oracle_sql()[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
