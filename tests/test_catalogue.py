"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in os.listdir(FOLDER):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{FOLDER}/{t}'")
    return c


def rows(frame, columns):
    return sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = db.sql(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got = got.astype({c: "float64" for c in columns if str(want[c].dtype) == "float64"})
    assert rows(got, columns) == rows(want, columns)
