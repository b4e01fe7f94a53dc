"""Every registered query against its SQL counterpart, and a look at the plans."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from registry.oracles import ORACLES, WITHOUT_SQL
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES) | WITHOUT_SQL
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert forbidden not in plan
