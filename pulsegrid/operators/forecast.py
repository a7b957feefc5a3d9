"""Expansion of one-step predictions to a horizon, and forecast errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions import expressions as X
from pulsegrid.operators import ordered


def _steps(df: DataFrame, steps: int, at: str) -> DataFrame:
    """One row per step; step ``i`` is ``i + 1`` minutes after ``at``."""
    spread = df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    later = F.col(at) + F.make_dt_interval(mins=F.col("step") + 1)
    return spread.withColumn("forecast_ts", later)


def expand_decay(pred: DataFrame, horizon: int, decay: float = 0.95, value: str = "prediction", at: str = "ts") -> DataFrame:
    """``prediction * decay ** i`` for every minute of the horizon."""
    forecast = F.col(value) * F.pow(F.lit(decay), F.col("step").cast("double"))
    return _steps(pred, horizon, at).withColumn("forecast", forecast)


def expand_mean_reverting(
    pred: DataFrame,
    horizon: int,
    decay: float = 0.98,
    value: str = "prediction",
    mean: str = "mean",
    at: str = "ts",
    shown: int = 60,
) -> DataFrame:
    """Drift of the prediction towards the mean, clamped to [0, 100], at most ``shown`` steps.

    Closed form of the step-by-step recursion.
    """
    raw = F.col(mean) + (F.col(value) - F.col(mean)) * F.pow(F.lit(decay), F.col("step").cast("double"))
    return _steps(pred, min(shown, horizon), at).withColumn("forecast", X.clamp(raw, 0.0, 100.0))


def confidence(horizon: Column) -> Column:
    """Falls by 0.3 over a day of horizon."""
    return 0.85 - horizon / 1440 * 0.3


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Forecast rows with the actual value of the same series and time, and the errors."""
    joined = ordered.join_nullsafe(forecast, actual.select(*keys, ts, F.col("value").alias("actual")), [*keys, ts], "left")
    error = F.col("actual") - F.col("forecast")
    return joined.withColumns(
        {
            "error": error,
            "abs_error": F.abs(error),
            "pct_error": F.abs(F.try_divide(error, F.col("actual"))) * 100,
        }
    )
