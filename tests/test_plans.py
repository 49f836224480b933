"""Plan-shape guards: the properties the design relies on at scale."""

import pytest

from freightcube.plans.catalog import QUERIES

from conftest import SF_SMALL

SKIP = {"od_cube_streamed"}      # runs a stream while it is built; its cube is plain joins + sums


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SKIP))
def test_no_nested_loop_or_cartesian_joins(spark, name):
    plan = physical(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_selection_reaches_the_stored_cube_scan(spark):
    plan = physical(QUERIES["flow_table_mixed"](spark, SF_SMALL))
    assert "PushedFilters: [In(dest_cnty" in plan or "In(dest_cnty" in plan
    assert "In(orig_reg" in plan and "In(orig_cnty" in plan


def test_cube_aggregates_before_joining_suppliers(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QUERIES["od_cube"](spark, SF_SMALL)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the supplier relation (s_name) is joined above the aggregate over the fact
    agg_at = plan.find("Aggregate [orig_cnty")
    supp_at = plan.find("s_name")
    assert 0 <= supp_at and 0 <= agg_at
    lines = plan.splitlines()
    depth = lambda pat: next(len(ln) - len(ln.lstrip(" :+-")) for ln in lines if pat in ln)
    assert depth("Join Inner") < depth("Aggregate [orig_cnty")


def test_fact_scan_reads_only_needed_columns(spark):
    plan = physical(QUERIES["od_cube"](spark, SF_SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_quantity:double>" in plan
