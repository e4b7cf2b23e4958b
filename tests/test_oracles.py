"""Every registered query of the flood-change operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def canonical(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or getattr(getattr(value, "dtype", None), "kind", "") in "iuf" and hasattr(value, "dtype"):
        return repr(round(float(value), 6))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(canonical, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
