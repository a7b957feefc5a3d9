"""Physical plans: pushdown, pruning, no cross joins, one shuffle of raw rows."""

from __future__ import annotations

import re

import pytest
from paths import SMALL

from __spark_entry__ import queries

# Plans whose Python part is the point of the query.
# score_points_prior: quartiles over all earlier hours are one ordered pass per series, which no window function gives.
PYTHON = {"trend_p_values", "cooled_alerts", "request_quota", "score_points_prior"}
PLAIN = [n for n, q in queries().items() if not q.__module__.endswith("queries_models")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLAIN)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON:
        assert not re.search(r"EvalPython|InPandas", plan)


def test_range_reaches_the_scan_with_needed_columns(spark):
    plan = plan_of(queries()["query_metrics_cpu"](spark, SMALL))
    filters = re.search(r"PushedFilters: \[([^\]]*)", plan).group(1)
    assert "GreaterThanOrEqual(ts" in filters and "LessThan(ts" in filters
    assert "props" not in re.search(r"ReadSchema: struct<([^\n]*)", plan).group(1)


@pytest.fixture
def shuffle_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_raw_rows_are_shuffled_once_for_window_and_join(spark, shuffle_joins):
    plan = plan_of(queries()["series_positions"](spark, SMALL))
    rows_side = plan[: plan.index("FileScan")]
    assert "SortMergeJoin" in rows_side and rows_side.count("Exchange hashpartitioning(_key") == 1


def test_limits_are_applied_before_the_shuffle(spark):
    plan = plan_of(queries()["tail_10_raw"](spark, SMALL))
    assert "WindowGroupLimit" in plan


def test_risk_windows_see_hourly_rows_only(spark):
    plan = plan_of(queries()["hour_risk"](spark, SMALL))
    first_window = plan[plan.rindex("Window ["):]
    assert "HashAggregate" in first_window and "partial_avg(value" in first_window


@pytest.mark.parametrize("name,scans,exchanges", [("sustained_high_memory", 1, 2), ("request_quota", 4, 3)])
def test_scans_and_exchanges(spark, shuffle_joins, name, scans, exchanges):
    plan = plan_of(queries()[name](spark, SMALL))
    assert plan.count("FileScan") <= scans
    # quota: the log twice, once for requests without a time, and two small stored tables
    assert len(re.findall(r"(?<!Reused)Exchange (?:hash|range|Single)", plan)) <= exchanges, plan


def test_grid_rows_are_reduced_before_their_first_shuffle(spark):
    plan = plan_of(queries()["minute_grid_filled"](spark, SMALL))
    below = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "partial_avg" in below
