"""Every core query against its SQL in DuckDB, on the smallest tables; queries without SQL must run."""

import glob
import os

import numpy as np
import pytest

from pelorus.plans import catalogue, problems

DATA = "/root/testdata/sf0.001"
QUERIES = {**catalogue.QUERIES, **problems.QUERIES}
SQL = {**catalogue.SQL, **problems.SQL}
# minutes of recursion in DuckDB or many small jobs: compared by the driver, not here
SLOW = {"find_blobs", "sigma_clip", "tukey_outliers", "biweight", "iterative_source_finding", "region_merging", "gauss_mixture", "superpixels", "blob_shapes"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def value(v):
    if isinstance(v, (list, np.ndarray)):
        return str([value(x) for x in v])
    if v is None or v != v or str(v) in ("NaT", "None", "<NA>"):
        return None
    if isinstance(v, np.generic):
        v = v.item()
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        expected = duck.sql(SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        a, b = rows(got), rows(expected)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y, abs=1e-4) if all(isinstance(v, (int, float)) for v in x) else x == y
