"""The corpus queries that have SQL give the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from evidentia.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, wanted = Q.QUERIES[name](spark, SF), con.execute(Q.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(wanted.fetchall())
