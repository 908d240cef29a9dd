"""Every query of the catalogue against its SQL in DuckDB, on the smallest driver tables."""

import glob
import os

import duckdb
import pytest

from quarry.plans import catalog, record_catalog  # noqa: F401

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def canonical(df):
    def text(v):
        if isinstance(v, float):
            return "null" if v != v else repr(round(v, 6)) if v != int(v) else str(int(v))
        return "null" if v is None else str(v)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, DIR).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)
