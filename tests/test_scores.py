"""Golden values of the scorers, the risk tables and the disk score."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import expressions as X
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import disk as D
from pulsegrid.operators import forecast as P
from pulsegrid.operators import risk as K
from pulsegrid.operators import windows as W
from pulsegrid.operators.significance import with_p_value
from pulsegrid.schema import DEFAULT_RISK

START = datetime(2024, 1, 1)
GOLDEN = [10.0, 12, 11, 13, 15, 14, 12, 11, 10, 16, 18, 20]


def series_of(spark, values, metric="m", host="h", start=START, step=timedelta(hours=1)):
    rows = [(host, metric, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "host string, metric string, ts timestamp_ntz, value double")


def scored(spark, values, current):
    series = series_of(spark, values)
    observed = series_of(spark, [current], start=START + timedelta(days=40))
    row = K.score_points(series, observed=observed).first()
    return [row[m] for m in ("zscore", "iqr", "ma", "ewma", "score")]


@pytest.mark.parametrize(
    "current, want",
    [
        (14, [0.032588, 0, 0.030982, 0.192653, 0.054423]),
        (25, [0.749513, 0.529412, 0.764228, 0.825928, 0.649503]),
        (30, [1, 1, 1, 1, 0.9]),
        (2, [0.749513, 0.411765, 0.898484, 1, 0.694352]),
    ],
)
def test_golden_scores(spark, current, want):
    assert scored(spark, GOLDEN, current) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("n, nonzero", [(2, []), (3, [0, 3]), (4, [0, 1, 3]), (6, [0, 1, 3]), (7, [0, 1, 2, 3])])
def test_minimum_lengths(spark, n, nonzero):
    got = scored(spark, GOLDEN[:n], 1000)
    assert [i for i, v in enumerate(got[:4]) if v > 0] == nonzero


def test_constant_series_scores_zero(spark):
    assert scored(spark, [5.0] * 12, 50) == [0, 0, 0, 0, 0]


def test_trend_golden_and_constant(spark):
    row = A.trend(series_of(spark, GOLDEN)).first()
    assert (row["slope"], row["r2"], row["trend"]) == (
        pytest.approx(0.594406, abs=1e-6), pytest.approx(0.447119, abs=1e-6), "increasing"
    )
    flat = A.trend(series_of(spark, [5.0] * 12)).first()
    assert (flat["slope"], flat["r2"], flat["trend"]) == (0, 0, "stable")
    short = A.trend(series_of(spark, GOLDEN[:9])).first()
    assert (short["slope"], short["trend"]) == (0, "stable")


def test_p_value_against_numerical_integral(spark):
    row = with_p_value(A.trend(series_of(spark, GOLDEN))).first()
    t = np.sqrt(row["r2"] * 10 / (1 - row["r2"]))
    x = np.linspace(t, t + 2000, 4_000_001)
    density = (1 + x * x / 10) ** -5.5
    from math import gamma, pi, sqrt

    density *= gamma(5.5) / (sqrt(10 * pi) * gamma(5))
    assert row["p_value"] == pytest.approx(2 * np.trapezoid(density, x), abs=1e-6)


def test_trend_bonus_is_capped_and_needs_r2(spark):
    rising = series_of(spark, [float(v) for v in range(1, 49)])
    row = K.hour_risk(rising).orderBy("hour").first()
    assert row["trend"] == "increasing" and row["risk"] == pytest.approx(min(row["ensemble"] + 0.1, 1))


def test_missing_hours_use_series_mean_or_zero(spark):
    series = series_of(spark, GOLDEN)
    late = K.hour_risk(series).where("hour = 20").first()
    assert late["expected"] == pytest.approx(13.5) and late["pattern"] == 0
    assert A.hourly_profile(series).where("hour = 20").first()["profile"] == 0
    assert A.hourly_profile(series).count() == 24


def test_peak_risk_golden(spark):
    rows = []
    for day in range(3):
        for hour in range(24):
            rows.append(("h", "m", START + timedelta(days=day, hours=hour), 20.0 + hour))
    extremes = spark.createDataFrame(
        [("h", "m", 50.0, 10.0, 3)], "host string, metric string, hist_max double, hist_min double, days int"
    )
    series = spark.createDataFrame(rows, "host string, metric string, ts timestamp_ntz, value double")
    ranked = {r["hour"]: r["hour_rank"] for r in W.hour_rank(A.hourly_profile(series)).collect()}
    assert (ranked[23], ranked[0]) == (0, 23)
    # The profile of the golden table with its extremes in place of the series' own.
    original = A.peak_baseline
    try:
        A.peak_baseline = lambda *_: extremes
        got = {r["hour"]: r for r in K.peak_risk(series).collect()}
    finally:
        A.peak_baseline = original
    want = {0: (0.2, 0.3, 0.191667, 0.230556), 12: (0.32, 0.3, 0.091667, 0.237222), 23: (0.43, 0.3, 0, 0.243333)}
    for hour, values in want.items():
        row = got[hour]
        assert (row["f_max"], row["f_min"], row["f_hour"], row["risk"]) == pytest.approx(values, abs=1e-6)


def test_peak_risk_without_factors_and_short_span(spark):
    row = K.peak_risk(series_of(spark, [0.0, 0.0])).where("hour = 0").first()
    assert (row["f_max"], row["f_min"], row["f_hour"], row["risk"]) == (None, None, None, 0)


def test_gap_days_count_towards_the_span(spark):
    series = series_of(spark, [1.0, 2.0], step=timedelta(days=3))
    row = A.day_span(series).first()
    assert (row["span_days"], row["observed_days"]) == (4, 2)


def test_overall_divides_by_configured_metrics(spark):
    risk = K.hour_risk(series_of(spark, GOLDEN))
    one = K.overall_risk(risk, 1).where("hour = 0").first()["overall_risk"]
    five = K.overall_risk(risk, 5).where("hour = 0").first()["overall_risk"]
    assert five == pytest.approx(one / 5)


def test_levels_are_strict_and_high_risk_is_not(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.71,)], "overall_risk double")
    levels = [r[0] for r in df.select(X.risk_level(F.col("overall_risk"))).collect()]
    assert levels == ["normal", "warning", "critical"]
    assert A.high_risk(df).count() == 3


def test_weights_may_be_missing(spark):
    params = replace(DEFAULT_RISK, weights={"zscore": 1.0})
    row = K.score_points(series_of(spark, GOLDEN), params=params).orderBy(F.desc("value")).first()
    others = row["iqr"] + row["ma"] + row["ewma"] + row["pattern"]
    assert row["score"] == pytest.approx(row["zscore"] + 0.2 * others)


@pytest.mark.parametrize(
    "values, want",
    [
        ((None, None, None, None, None), 0.05),
        ((0, None, None, 40, 1000), 0.05),
        ((50, None, None, None, None), 0.5),
        ((200, None, None, None, None), 0.95),
        ((10, 25, 5, 70, 30000), 0.309091),
        ((None, None, None, 100, 20000), 0.95),
        ((None, None, None, 60, 20000), 0.05),
    ],
)
def test_disk_score(spark, values, want):
    names = "reallocated_sector_ct long, pending_sector_ct long, uncorrectable_errors long, temperature_celsius long, power_on_hours long"
    row = D.score_disks(spark.createDataFrame([values], names)).first()
    assert row["failure_probability"] == pytest.approx(want, abs=1e-6)


def test_mean_reverting_forecast(spark):
    pred = spark.createDataFrame([("h", START, 70.0, 40.0)], "host string, ts timestamp_ntz, prediction double, mean double")
    rows = P.expand_mean_reverting(pred, 5).orderBy("step").collect()
    assert [round(r["forecast"], 4) for r in rows] == [70, 69.4, 68.812, 68.2358, 67.671]
    assert rows[0]["forecast_ts"] == START + timedelta(minutes=1)


def test_ewma_closed_form_is_the_fold(spark):
    values = np.random.default_rng(1).normal(50, 10, 300)
    ewma = values[0]
    for v in values[1:]:
        ewma = 0.3 * v + 0.7 * ewma
    var = np.var(values[:10])
    for v in values:
        var = 0.3 * (v - ewma) ** 2 + 0.7 * var
    for bounded in (True, False):
        row = W.ewma_stats(series_of(spark, values), bounded=bounded).first()
        assert (row["ewma"], row["ewma_var"]) == (pytest.approx(ewma), pytest.approx(var))


def test_zscore_is_invariant_to_shift_and_scale(spark):
    moved = [3 * v + 7 for v in GOLDEN]
    assert scored(spark, GOLDEN, 25)[0] == pytest.approx(scored(spark, moved, 3 * 25 + 7)[0])


def test_scores_stay_in_range_and_below_weights(spark):
    values = np.random.default_rng(3).exponential(10, 60)
    for history in ("series", "prior"):
        rows = K.score_points(series_of(spark, values), history=history).collect()
        assert len(rows) == 60
        for row in rows:
            assert all(0 <= row[m] <= 1 for m in ("zscore", "iqr", "ma", "ewma", "pattern", "score"))


def test_prior_scores_use_the_whole_history(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(1e6, 3, 400)
    values[50] = np.nan
    quartiles = K._running(values, 0.3)
    for i in (1, 2, 11, 60, 399):
        past = values[:i][~np.isnan(values[:i])]
        ewma = past[0]
        for v in past[1:]:
            ewma += 0.3 * (v - ewma)
        var = np.var(past[:10])
        for v in past:
            var = 0.3 * (v - ewma) ** 2 + 0.7 * var
        want = [*np.quantile(past, [0.25, 0.75]), ewma, np.sqrt(var)]
        assert quartiles[i] == pytest.approx(want, rel=1e-8)
    assert np.isnan(quartiles[0]).all()
