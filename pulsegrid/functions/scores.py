"""The five scorers, the ensemble and the trend rule as column functions.

Every scorer takes aggregates of the history (one value per series) and the
current value, and returns a number in [0, 1].  Deviations are population
deviations throughout.  Too short a history, or one without spread, scores 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsegrid.schema import DEFAULT_RISK, RiskParams


def _deviation_score(current: Column, centre: Column, spread: Column, full_scale: float) -> Column:
    """Deviations from the centre, as a share of ``full_scale`` deviations, at most 1."""
    return F.least(F.try_divide(F.abs(current - centre), spread) / full_scale, F.lit(1.0))


def _guarded(score: Column, n: Column, minimum: int, spread: Column) -> Column:
    enough = (n >= minimum) & (spread != 0)
    return F.when(enough, score).otherwise(0.0)


def zscore_score(current: Column, n: Column, mean: Column, std: Column, threshold: float = 2.5) -> Column:
    """A z-score equal to the threshold scores 0.5."""
    return _guarded(_deviation_score(current, mean, std, 2 * threshold), n, 3, std)


def iqr_score(current: Column, n: Column, q1: Column, q3: Column, multiplier: float = 1.5) -> Column:
    """Distance beyond the fences in units of the interquartile range; 0 between them."""
    iqr = q3 - q1
    low, high = q1 - multiplier * iqr, q3 + multiplier * iqr
    outside = F.greatest(low - current, current - high, F.lit(0.0))
    return _guarded(F.least(F.try_divide(outside, iqr) / multiplier, F.lit(1.0)), n, 4, iqr)


def ma_score(
    current: Column, n: Column, mean: Column, std: Column, window: int = 7, multiplier: float = 2.0
) -> Column:
    """``mean`` and ``std`` cover the last ``window`` values; ``n`` counts the whole history."""
    return _guarded(_deviation_score(current, mean, std, 2 * multiplier), n, window, std)


def ewma_score(current: Column, n: Column, ewma: Column, std: Column, deviations: float = 3.0) -> Column:
    return _guarded(_deviation_score(current, ewma, std, deviations), n, 3, std)


def pattern_score(
    current: Column, hour_n: Column, hour_mean: Column, hour_std: Column, threshold: float = 2.5
) -> Column:
    """The z-score rule over the values of the same hour of day; 0 when the hour has no history."""
    return F.coalesce(zscore_score(current, hour_n, hour_mean, hour_std, threshold), F.lit(0.0))


# Scorer registry: name -> function of (current value, parameters) over the column
# names that ``operators.risk.series_baseline`` and ``hourly_stats`` produce.
SCORERS: dict[str, Callable[[Column, RiskParams], Column]] = {
    "zscore": lambda c, p: zscore_score(c, F.col("n"), F.col("mean"), F.col("std"), p.zscore_threshold),
    "iqr": lambda c, p: iqr_score(c, F.col("n"), F.col("q1"), F.col("q3"), p.iqr_multiplier),
    "ma": lambda c, p: ma_score(
        c, F.col("n"), F.col("ma_mean"), F.col("ma_std"), p.ma_window, p.ma_std_multiplier
    ),
    "ewma": lambda c, p: ewma_score(c, F.col("n"), F.col("ewma"), F.col("ewma_std"), p.ewma_deviations),
    "pattern": lambda c, p: pattern_score(
        c, F.col("hour_n"), F.col("hour_mean"), F.col("hour_std"), p.zscore_threshold
    ),
}


def ensemble_score(scores: dict[str, Column], params: RiskParams = DEFAULT_RISK) -> Column:
    """Weighted sum, not normalised; a method without a weight gets ``missing_weight``."""
    total = F.lit(0.0)
    for method, score in scores.items():
        total = total + F.lit(float(params.weights.get(method, params.missing_weight))) * score
    return total


def trend_direction(n: Column, slope: Column, mean: Column) -> Column:
    """Stable below 10 values or below 1 % of the mean per step.

    With a negative mean that bound is negative, so such a series is never stable.
    """
    return (
        F.when(n < 10, "stable")
        .when(F.abs(slope) < 0.01 * mean, "stable")
        .when(slope > 0, "increasing")
        .otherwise("decreasing")
    )


def trend_adjust(score: Column, trend: Column, r2: Column, params: RiskParams = DEFAULT_RISK) -> Column:
    rising = (trend == "increasing") & (r2 > params.trend_min_r2)
    return F.least(score + F.when(rising, params.trend_bonus).otherwise(0.0), F.lit(1.0))
