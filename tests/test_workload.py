"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import pytest

from tablewright.plans.lineage import clear_steps
from workload import ORACLES, QUERIES
from workload.check import compare, connect

FOLDER = os.environ.get("SMALL_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    clear_steps(spark)
    res = duck.execute(ORACLES[name])
    assert compare(df.columns, rows, [c[0] for c in res.description], res.fetchall()) == ""
