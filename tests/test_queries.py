"""Every named query against its check SQL, and on empty input."""

import pytest
from pyspark.sql import types as T

import __spark_entry__ as entry
from check import compare, duck, passed
from oracle import ORACLES
from salesflow.catalog import QUERIES
from salesflow.sources.star import VIEWS, view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return duck(SF)


def test_every_query_has_check_sql():
    assert set(QUERIES) == set(ORACLES) and QUERIES.keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 7


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_check_sql(spark, con, name):
    verdict = compare(spark, con, name, SF)
    assert passed(verdict) and verdict.startswith("ok"), verdict


@pytest.fixture(scope="session")
def empty(spark):
    schemas = {v: {f.name: f for f in view(spark, SF, v).schema} for v in VIEWS}
    return lambda v, cols: spark.createDataFrame([], T.StructType([schemas[v][c] for c in cols or VIEWS[v]]))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_input(spark, empty, name):
    q = QUERIES[name]
    q.build(empty(q.source, q.columns)).collect()
