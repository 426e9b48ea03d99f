"""Every registered query of the collections against its SQL in DuckDB, on the driver's smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from keyfold.plans import catalog

DATA = os.environ.get("KEYFOLD_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r))
    return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_sample_is_of_the_set(spark):
    got = catalog.QUERIES["sop_sample"](spark, DATA)
    every = catalog.QUERIES["sop_get_all"](spark, DATA)
    assert got.subtract(every).isEmpty()
    assert got.groupBy("key").count().where("count > 5").isEmpty()
