"""Every registered query of the library against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans import more_queries, queries, source_queries, view_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    def norm(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "-"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:26]
        return repr(round(float(v), 8)) if isinstance(v, float) else str(v)

    return sorted(tuple(norm(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
