"""Every registered query against its DuckDB twin, or for its rows where it has none."""

import glob
import os

import duckdb
import pytest

from lexlake.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _rows(df):
    names = sorted(df.columns)
    text = df[names].astype(str).replace({"None": "", "nan": "", "NaT": "", "<NA>": ""})
    return sorted(tuple(x[:-2] if x.endswith(".0") else x for x in row) for row in text.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        expected = con.execute(SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert _rows(found) == _rows(expected)
    else:
        assert len(found.columns) and len(found)
