"""Every registered query against its DuckDB form, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from chronoweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def plain(df):
    out = {}
    for c in sorted(df.columns):
        try:
            out[c] = df[c].astype("float64").round(5) + 0.0
        except (TypeError, ValueError):
            out[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: None if v is None else str(v))
    out = pd.DataFrame(out)
    return out.sort_values(list(out.columns), na_position="first", ignore_index=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, sql, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = sql.execute(catalog.ORACLES[name]).df()
    assert sorted(want.columns) == sorted(got.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
