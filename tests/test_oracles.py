"""Every query with an oracle gives what its SQL gives, on the smallest tables; those without one give rows."""

import math
import os
from glob import glob

import duckdb
import pytest

from lattiq.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("LATTIQ_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Runs of many rounds; they are covered on small inputs in the other modules.
LONG = {"knn_nn_descent", "layout_vectors"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob(f"{DATA}/*.parquet"):
        connection.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "none"
        return round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str), sorted(columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    made = QUERIES[name](spark, DATA)
    truth = tables.sql(ORACLES[name])
    assert plain([tuple(r) for r in made.collect()], made.columns) == plain(truth.fetchall(), truth.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
