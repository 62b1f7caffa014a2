"""The queries with SQL give the rows that DuckDB gives."""

import duckdb
import pytest

from tessera.llm.queries import queries
from tessera.llm.sql import oracle_sql


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries()[name](spark, sf)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.project(", ".join(columns)).fetchall())
