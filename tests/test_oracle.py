"""Every registered query with reference SQL against DuckDB on the small tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from arenalake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5)
    if isinstance(v, np.integer):
        return int(v)
    return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted((tuple(map(plain, r)) for r in df[sorted(got.columns)].itertuples(index=False)), key=repr) for df in (got, want)]
    assert rows[0] == rows[1]
