"""Every registered query against its SQL twin on the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from revloom.catalog import all_queries

SF = "/root/testdata/sf0.001"
# the catalogue's own queries; what a subpackage adds is tested with it
QUERIES = {key: run for key, run in driver.queries().items() if key in all_queries()}
ORACLE = {key: sql for key, sql in driver.oracle_sql().items() if key in QUERIES}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in places) for r in rows),
                  key=lambda r: tuple((x is None, str(x)) for x in r))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    found = QUERIES[key](spark, SF)
    result = duck.execute(ORACLE[key])
    names = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(names)
    assert ordered(found.columns, found.collect()) == ordered(names, result.fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert banned not in plan
