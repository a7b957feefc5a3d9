"""Distribution shift against plain code, and what it does with odd input."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pulsegrid.operators.drift import distribution_shift

ROWS = "k string, ts int, value double"


def plain(now: list[float], base: list[float]) -> tuple[float, float]:
    """Largest difference of the two distribution functions and the area between them, from their definition."""
    points = np.unique(np.concatenate((now, base)))
    gaps = np.abs([np.mean(np.array(now) <= x) - np.mean(np.array(base) <= x) for x in points])
    return float(gaps.max()), float((gaps[:-1] * np.diff(points)).sum())


def rows(spark, data):
    listed = [(k, t, v) for k, values in data.items() for t, v in enumerate(values)]
    return spark.createDataFrame(listed, ROWS).selectExpr("k", "timestamp_seconds(ts * 40) AS ts", "value")


def found(spark, data, **more):
    out = distribution_shift(rows(spark, data).repartition(5), ["k"], ["ts"], **more)
    return {(r["k"], r["bucket"]): r for r in out.collect()}


def test_distances_equal_plain_code(spark):
    rng = np.random.default_rng(5)
    data = {
        "steady": rng.normal(size=330).round(1).tolist(),  # many ties
        "moved": [*rng.normal(size=100).tolist(), *rng.normal(1, 1, size=130).tolist()],
        "wider": [*rng.normal(size=100).tolist(), *rng.normal(0, 4, size=100).tolist()],
        None: [3.0] * 250,
        "short": [1.0, 2.0],
    }
    got = found(spark, data, window=100)
    assert set(got) == {(k, b) for k, v in data.items() for b in range(-(-len(v) // 100))}
    for (k, b), r in got.items():
        now, base = data[k][b * 100 : b * 100 + 100], data[k][:100]
        ks, area = plain(now, base)
        assert r["n"] == len(now)
        assert r["ks"] == pytest.approx(ks, abs=1e-12) and r["wasserstein"] == pytest.approx(area, abs=1e-9)
        critical = math.sqrt(-math.log(0.025) / 2) * math.sqrt((len(now) + len(base)) / (len(now) * len(base)))
        assert r["critical"] == pytest.approx(critical)
        assert r["retrain"] == (ks > max(critical, 0.1))
    assert got["moved", 1]["retrain"] and got["wider", 1]["retrain"]
    assert not any(r["retrain"] for (k, _), r in got.items() if k in ("steady", None, "short"))


def test_shift_that_moments_do_not_show(spark):
    """Two peaks instead of one, with equal mean and deviation."""
    data = {"k": [*np.random.default_rng(2).normal(size=1000).tolist(), *([-1.0, 1.0] * 500)]}
    got = found(spark, data)
    assert got["k", 1]["retrain"] and got["k", 1]["ks"] > 0.3


def test_nulls_and_empty_tables(spark):
    data = {"gaps": [1.0, None, 2.0, None, None, None, 5.0, 6.0], "late": [None, None, None, None, 1.0]}
    got = found(spark, data, window=4)
    assert [got["gaps", b]["n"] for b in (0, 1)] == [2, 2] and got["gaps", 1]["ks"] == 1.0
    assert got["gaps", 1]["wasserstein"] == pytest.approx(4.0)
    assert (got["late", 1]["n"], got["late", 1]["ks"], got["late", 1]["critical"], got["late", 1]["retrain"]) == (1, None, None, False)
    assert found(spark, {}) == {}
