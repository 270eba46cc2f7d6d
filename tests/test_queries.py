"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from evidentia.plans import load

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CATALOGUE = load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, data):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(repr(plain(r[i])) for i in order) for r in data)), sorted(columns)


@pytest.mark.parametrize("name", sorted(CATALOGUE.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = CATALOGUE.QUERIES[name](spark, SF)
    found = duck.execute(CATALOGUE.ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in found.description], found.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 6
