"""Every bound query against its SQL on the smallest tables, and what the plans may hold."""

import pytest

import __spark_entry__ as contract
import compare
from catalogue import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.duck(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, connection, name):
    assert compare.differences(spark, connection, name, FOLDER)[1] == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


PYTHON_TASKS = {"similar_topk", "similar_topk_routed", "keyword_concept_map"} | {f"kendall_tau{kind}" for kind in ("", "_blocks", "_normal", "_ties")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_TASKS))
def test_plan_stays_in_the_jvm_without_cross_joins(spark, name):
    plan = contract.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
