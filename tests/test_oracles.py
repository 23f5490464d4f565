"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from quillmine.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def canon(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return list(frame.columns), sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert canon(registry.QUERIES[name](spark, SF).toPandas()) == canon(duck.execute(registry.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).columns
