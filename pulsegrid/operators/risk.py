"""Risk tables: hourly ensemble, observed points, peaks."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.functions import scores as S
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import ordered
from pulsegrid.operators import windows as W
from pulsegrid.operators.reshape import hour_spine
from pulsegrid.schema import DEFAULT_RISK, METHODS, RiskParams

KEYS = list(schema.SERIES_KEYS)


def series_baseline(series: DataFrame, keys: list[str] = KEYS, params: RiskParams = DEFAULT_RISK) -> DataFrame:
    """Everything the scorers need, once per series, from one shuffle by series.

    Input is the hourly series, so a group is bounded by the calendar.
    """
    whole = Window.partitionBy(*keys)
    n, rn, value = F.col("n"), F.col("rn"), F.col("value")
    indexed = series.withColumns(
        {"rn": F.row_number().over(whole.orderBy("ts")) - 1, "n": F.count(F.lit(1)).over(whole)}
    )
    averaged = indexed.withColumn("ewma", W.ewma_over(whole, params.ewma_alpha))
    recent = F.when(rn >= n - params.ma_window, value)
    seed = F.var_pop(F.when(rn < W.SEED_ROWS, value))
    terms = F.sum(W.ewma_variance_terms(n, rn, value, F.col("ewma"), params.ewma_alpha))
    var = F.pow(F.lit(1 - params.ewma_alpha), F.first("n").cast("double")) * seed + terms
    x = rn.cast("double")
    grouped = averaged.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
        F.avg(recent).alias("ma_mean"),
        F.stddev_pop(recent).alias("ma_std"),
        F.first("ewma").alias("ewma"),
        F.sqrt(var).alias("ewma_std"),
        F.regr_slope(value, x).alias("_slope"),
        F.regr_r2(value, x).alias("_r2"),
    )
    enough = n >= 10
    fitted = grouped.select(
        *keys, "n", "mean", "std",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"),
        "ma_mean", "ma_std", "ewma", "ewma_std",
        F.when(enough, F.col("_slope")).otherwise(0.0).alias("slope"),
        F.when(enough & (F.col("std") != 0), F.col("_r2")).otherwise(0.0).alias("r2"),
    )
    return fitted.withColumn("trend", S.trend_direction(n, F.col("slope"), F.col("mean")))


def _scored(df: DataFrame, current: Column, params: RiskParams) -> DataFrame:
    with_scores = df.withColumns({m: S.SCORERS[m](current, params) for m in METHODS})
    return with_scores.withColumn("ensemble", S.ensemble_score({m: F.col(m) for m in METHODS}, params))


def hour_risk(
    series: DataFrame,
    keys: list[str] = KEYS,
    params: RiskParams = DEFAULT_RISK,
    baseline: DataFrame | None = None,
) -> DataFrame:
    """Risk of the *expected* value of each hour of day, per series.

    The value scored is the mean of that hour, or of the series when the hour
    has no data; its ``pattern`` score is therefore 0 by construction, and is
    set to exactly 0 here.  ``score_points`` scores observations.
    """
    stats = baseline if baseline is not None else series_baseline(series, keys, params)
    hours = A.hourly_stats(series, keys)
    slots = ordered.join_nullsafe(hour_spine(stats), hours, [*keys, "hour"], "left")
    slots = slots.withColumn("expected", F.coalesce("hour_mean", "mean"))
    scored = _scored(slots, F.col("expected"), params).withColumn("pattern", F.lit(0.0))
    scored = scored.withColumn("ensemble", S.ensemble_score({m: F.col(m) for m in METHODS}, params))
    risk = S.trend_adjust(F.col("ensemble"), F.col("trend"), F.col("r2"), params)
    with_risk = scored.withColumn("risk", risk)
    level = X.risk_level(F.col("risk"), params.warning, params.critical)
    return with_risk.select(
        *keys, "hour", "expected", *METHODS, "ensemble", "trend",
        F.col("slope"), F.col("r2"), "risk", level.alias("level"),
    )


def overall_risk(
    risk: DataFrame, n_metrics: int, keys: tuple[str, ...] = ("host",), params: RiskParams = DEFAULT_RISK
) -> DataFrame:
    """Sum of the metric risks over the number of *configured* metrics, with or without data."""
    total = F.sum("risk") / n_metrics if n_metrics else F.lit(0.0)
    overall = risk.groupBy(*keys, "hour").agg(total.alias("overall_risk"))
    level = X.risk_level(F.col("overall_risk"), params.warning, params.critical)
    return overall.withColumn("overall_level", level)


def with_metric_map(risk: DataFrame, overall: DataFrame, fields: list[str], keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The nested form: one row per hour with ``metrics MAP<STRING, STRUCT>``.

    A map holds one entry per configured metric of a host.
    """
    entry = F.struct(F.col("metric"), F.struct(*fields))
    nested = risk.groupBy(*keys, "hour").agg(F.map_from_entries(F.collect_list(entry)).alias("metrics"))
    return ordered.join_nullsafe(overall, nested, [*keys, "hour"], "left")


def score_points(
    series: DataFrame,
    keys: list[str] = KEYS,
    params: RiskParams = DEFAULT_RISK,
    history: str = "series",
    baseline: DataFrame | None = None,
    hours: DataFrame | None = None,
    observed: DataFrame | None = None,
    salts: int = 16,
) -> DataFrame:
    """Score observations with the same scorers.

    ``history='series'``: against the whole series, one baseline per series.
    ``observed`` (default: the series itself) may be raw points; their lookup is
    salted because a few series can own most of the rows.
    ``history='prior'``: against the rows before each row (see ``prior_baseline``).
    """
    if history == "prior":
        base = prior_baseline(series, keys, params)
    elif history == "series":
        stats = baseline if baseline is not None else series_baseline(series, keys, params)
        profile = hours if hours is not None else A.hourly_stats(series, keys)
        rows = observed if observed is not None else series
        columns = [c for c in rows.columns if c not in keys]
        rows = rows.withColumn("hour", F.hour("ts"))
        base = ordered.salted_lookup(rows, stats, keys, ["ts", "value"], salts)
        base = ordered.salted_lookup(base, profile, [*keys, "hour"], ["ts", "value"], salts, "left")
        base = base.select(*keys, *columns, "hour", "n", "mean", "std", "q1", "q3", "ma_mean", "ma_std",
                           "ewma", "ewma_std", "hour_n", "hour_mean", "hour_std")
    else:
        raise ValueError(f"unknown history: {history}")
    scored = _scored(base, F.col("value"), params)
    level = X.risk_level(F.col("ensemble"), params.warning, params.critical)
    kept = [c for c in (observed if observed is not None else series).columns if c not in keys]
    return scored.select(*keys, *kept, *METHODS, F.col("ensemble").alias("score"), level.alias("level"))


def prior_baseline(series: DataFrame, keys: list[str] = KEYS, params: RiskParams = DEFAULT_RISK) -> DataFrame:
    """Baseline columns of all rows before each row of the hourly series.

    Moments and the hour pattern are window frames; quartiles and EWMA come from
    one ordered pass per series over the same partitions.  A series of hourly rows
    is bounded by the calendar.
    """
    spec = Window.partitionBy(*keys).orderBy("ts")
    before = spec.rowsBetween(Window.unboundedPreceding, -1)
    recent = spec.rowsBetween(-params.ma_window, -1)
    same_hour = Window.partitionBy(*keys, "hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    framed = series.withColumn("hour", F.hour("ts")).withColumns(
        {
            "hour_n": F.count("value").over(same_hour),
            "hour_mean": F.avg("value").over(same_hour),
            "hour_std": F.stddev_pop("value").over(same_hour),
        }
    )
    framed = framed.withColumns(
        {
            "n": F.count("value").over(before),
            "mean": F.avg("value").over(before),
            "std": F.stddev_pop("value").over(before),
            "ma_mean": F.avg("value").over(recent),
            "ma_std": F.stddev_pop("value").over(recent),
        }
    )
    alpha = params.ewma_alpha

    def running(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        return pdf.assign(**dict(zip(RUNNING, _running(pdf["value"].to_numpy(dtype=float), alpha).T)))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in framed.schema)
    return framed.groupBy(*keys).applyInPandas(running, f"{types}, " + ", ".join(f"{c} double" for c in RUNNING))


RUNNING = ("q1", "q3", "ewma", "ewma_std")


def _running(values: np.ndarray, alpha: float) -> np.ndarray:
    """Quartiles, EWMA and its deviation of the values before each value; missing values are passed over.

    The EWMA variance weighs squared distances from the *current* EWMA, so a weighted
    mean and sum of squares with fading weights are carried and shifted to it.
    """
    out = np.full((len(values), len(RUNNING)), np.nan)
    arranged: list[float] = []
    seeds: list[float] = []
    ewma = weight = centre = squares = seed_var = 0.0
    for i, value in enumerate(values):
        n = len(arranged)
        if n:
            var = (1 - alpha) ** n * seed_var + squares + weight * (centre - ewma) ** 2
            out[i] = _quantile(arranged, 0.25), _quantile(arranged, 0.75), ewma, math.sqrt(max(var, 0.0))
        if math.isnan(value):
            continue
        ewma = value if n == 0 else ewma + alpha * (value - ewma)
        weight, squares = (1 - alpha) * weight + alpha, (1 - alpha) * squares
        apart = value - centre
        centre += apart * alpha / weight
        squares += alpha * apart * (value - centre)
        bisect.insort(arranged, value)
        if len(seeds) < W.SEED_ROWS:
            seeds.append(value)
            seed_var = float(np.var(seeds))
    return out


def _quantile(arranged: list[float], p: float) -> float:
    """Linear-interpolated quantile of a sorted list."""
    position = p * (len(arranged) - 1)
    low, high = arranged[math.floor(position)], arranged[math.ceil(position)]
    return low + (high - low) * (position - math.floor(position))


def peak_risk(series: DataFrame, keys: list[str] = KEYS, params: RiskParams = DEFAULT_RISK) -> DataFrame:
    """Risk per hour of day from the distance to historical peaks.

    Factors: half the expected value's share of the maximum; 0.3 times its
    relative distance from a positive minimum (at most 1); with three or more
    calendar days, 0.2 times the hour's rank over 24, where the busiest hour
    ranks 0 and so adds nothing.  The risk is the *mean* of the factors present:
    for non-negative data it stays at or below 0.5, so default thresholds never
    raise a level.
    """
    history = A.peak_baseline(A.daily_peaks(series, keys), keys)
    ranked = W.hour_rank(A.hourly_profile(series, keys), keys)
    slots = ordered.join_nullsafe(ranked, history, keys)
    expected, high, low = F.col("profile"), F.col("hist_max"), F.col("hist_min")
    factors = {
        "f_max": F.when(high > 0, F.try_divide(expected, high) * 0.5),
        "f_min": F.when(
            (low > 0) & (expected > 0), F.least(F.try_divide(expected - low, low), F.lit(1.0)) * 0.3
        ),
        "f_hour": F.when(F.col("days") >= 3, F.col("hour_rank") / schema.SLOTS * 0.2),
    }
    slots = slots.withColumns(factors)
    total, present = F.lit(0.0), F.lit(0)
    for name in factors:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
        present = present + F.col(name).isNotNull().cast("int")
    risk = F.coalesce(F.try_divide(total, present), F.lit(0.0))
    with_risk = slots.withColumn("risk", risk)
    level = X.risk_level(F.col("risk"), params.warning, params.critical)
    return with_risk.select(
        *keys, "hour", F.col("profile").alias("expected"), "hist_max", "hist_min", "days",
        *factors, "risk", level.alias("level"),
    )
