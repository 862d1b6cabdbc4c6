"""Every registered query against its SQL, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry_points
from workload.compare import differences, duckdb_session
from workload.inputs import relation, table
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duckdb_session(SF)


def test_every_query_has_its_sql():
    assert len(NAMES) == 62
    assert sorted(ORACLES) == NAMES
    assert QUERIES.items() <= entry_points.queries().items()
    assert ORACLES.items() <= entry_points.oracle_sql().items()


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    assert differences(spark, con, SF, name) is None


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_product_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                     "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert operator not in plan


def test_entry(spark):
    assert entry_points.entry(spark).count() == 26


def test_profile_reads_the_claimed_columns_only(spark):
    plan = QUERIES["unit_profile"](spark, SF)._jdf.queryExecution()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan.executedPlan().toString())
    assert schemas and not any("l_shipdate" in s or "l_returnflag" in s for s in schemas)


def test_distinct_values_are_counted_before_the_shuffle(spark):
    plan = QUERIES["distinct_values"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "Window" not in plan


def test_usage_window_filter_reaches_the_scan(spark):
    plan = QUERIES["usage_window"](spark, SF)._jdf.queryExecution()
    assert "GreaterThanOrEqual(ts," in plan.executedPlan().toString()


def test_ground_truth_holds_every_order_and_claim_type(spark):
    manifest = relation(spark, SF, "manifest")
    assert manifest.count() == table(spark, SF, "orders").count()
    assert {r["claim_type"] for r in manifest.select("claim_type").distinct().collect()} == {
        "unit_scale", "freshness", "completeness", "domain_enum", "deprecation_usage"}
