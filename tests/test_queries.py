"""Every registered query against its SQL twin, and the shape of its plan."""

import re

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry_point
from tidemark import registry

registry.load_all()

@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def no_product(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", sorted(registry.JOBS))
def test_matches_sql(spark, duck, sf_dir, name):
    rows, error = compare(spark, duck, name, registry.JOBS[name], registry.ORACLES.get(name), sf_dir, no_product)
    assert error is None, error
    assert rows > 0


def test_entry(spark):
    assert entry_point.entry(spark).limit(1).count() == 1
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_filters_reach_the_files(spark, sf_dir):
    plan = registry.JOBS["scan_filtered_sorted"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "In(o_orderstatus" in plan
    assert "o_orderpriority" not in plan


def test_series_share_one_shuffle_by_code(spark, sf_dir):
    plan = registry.JOBS["trend_segments"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # daily closes, then the series
