"""Corpus queries that SQL can express against DuckDB on the small tables."""

import duckdb
import pytest

from arenalake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_corpus_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(map(repr, df[sorted(got.columns)].astype(object).itertuples(index=False, name=None))) for df in (got, want)]
    assert rows[0] == rows[1] and rows[0]
