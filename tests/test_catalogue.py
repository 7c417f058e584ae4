"""Every registered query of the drawing lane against its SQL, on the smallest driver tables."""

import glob
import math
import os

import pytest

from sheetmeter.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = db.execute(catalogue.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
