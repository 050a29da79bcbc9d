"""Every registered query with SQL agrees with DuckDB on the sf 0.01 tables; the others run and return rows."""

import math
import os

import duckdb
import pandas as pd
import pytest

from levelcast.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    null = lambda x: x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x))
    return sorted((tuple(None if null(x) else x for x in r) for r in df.itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    found = registry.queries()[name](spark, SF).toPandas()
    assert len(found)
    if "converged" in found.columns:
        assert found.converged.all()  # the chains of every series
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    wanted = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
