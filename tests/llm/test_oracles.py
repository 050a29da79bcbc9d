"""The queries that SQL can express agree with DuckDB."""

import duckdb
import pytest

from levelcast.llm import oracles, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.001"])
def test_oracle(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(oracles.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    want, found = (d.sort_values(key).reset_index(drop=True) for d in (want, found))
    assert len(want) == len(found) > 0
    for c in want.columns:
        assert (want[c] == found[c]).all(), c


def test_embeddings_sql_follows_links(spark):
    from levelcast.llm import nndescent

    rows = [(1, [1.0, 0.0]), (2, [0.99, 0.14]), (3, [0.96, 0.28]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    embeddings = df.toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    want = con.sql(oracles.embeddings_sql()).df().sort_values("vec_id").reset_index(drop=True)
    found = nndescent.near_duplicates(df)[0].toPandas().sort_values("vec_id").reset_index(drop=True)
    assert found[want.columns].equals(want) or (found[want.columns] == want).all().all()
