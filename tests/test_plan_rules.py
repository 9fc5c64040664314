"""Guards for the scale rules, checked on every registered query's physical plan."""

import pytest

from psephos.plans.registry import QUERIES
from tests.conftest import SF_SMOKE

FORBIDDEN = {
    "CartesianProduct": "cross join",
    "BroadcastNestedLoopJoin": "nested-loop join",
    "BatchEvalPython": "row-at-a-time Python UDF",
    "ArrowEvalPython": "Python UDF in the query plan",
    "FlatMapGroupsInPandas": "a whole group through Python",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_forbidden_operators(spark, name):
    df = QUERIES[name](spark, SF_SMOKE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [why for op, why in FORBIDDEN.items() if op in plan]
    assert not found, f"{name}: {found}"


def test_grain_reads_only_the_columns_it_uses(spark):
    from psephos.sources.binding import WAREHOUSE_TABLES, ballot_grain, read_tables

    plan = ballot_grain(read_tables(spark, SF_SMOKE, WAREHOUSE_TABLES))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
