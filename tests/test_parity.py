"""Every registered query against its oracle statement on the small tables."""

from __future__ import annotations

import pytest
from paths import SMALL
from parity import compare, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries

# Model fits take long and have their own tests on fixtures.
SLOW = {"disk_model_predictions", "prediction_cycle", "training_run", "sequence_forecast", "detected_anomalies"}


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    problems = compare(queries()[name](spark, SMALL), oracle, oracle_sql()[name])
    assert [p for p in problems if p != "no rows"] == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_without_oracle_runs(spark, name):
    assert queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry(spark).count() == 4 * 5 * 24
