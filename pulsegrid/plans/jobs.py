"""Jobs that answer one question end to end, for all hosts at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import disk as D
from pulsegrid.operators import forecast as P
from pulsegrid.operators import reshape as R
from pulsegrid.operators import risk as K
from pulsegrid.operators import windows as W
from pulsegrid.operators.disk_model import predict_disk
from pulsegrid.schema import DEFAULT_RISK, RiskParams
from pulsegrid.sources import line_protocol as LP
from pulsegrid.sources import smart_text as ST
from pulsegrid.sources.points import Time, hourly_series, lookback, select_points


@dataclass(frozen=True)
class RiskTables:
    """Per (host, metric, hour) and per (host, hour)."""

    risk: DataFrame
    overall: DataFrame


def query_metrics(
    points: DataFrame,
    metric_type: str,
    fields: list[str],
    start: Time | None = None,
    stop: Time | None = None,
    host: str | None = None,
    aggregation: str = "mean",
    window: str = "1m",
    limit: int = 1000,
) -> DataFrame:
    """Windowed aggregate, one column per field, at most ``limit`` rows per host."""
    if metric_type not in schema.METRIC_TYPES:
        raise ValueError(f"unknown metric type: {metric_type}")
    rows = select_points(points, start, stop, metric_type, host, fields)
    means = A.aggregate_window(rows, ["host", "field"], window, aggregation)
    wide = R.pivot_fields(means, ["host", "ts"], fields, agg="first")
    return W.limit_per_series(wide, ["host"], limit)


def aligned_frame(points: DataFrame, fields: list[str], step: str = "1 minute") -> DataFrame:
    """Minute grid per host with ``measurement_field`` columns, gaps filled forward then back.

    One aggregate with conditional means replaces a scan and a join per measurement,
    so raw points are reduced to steps before they are shuffled.
    """
    named = points.withColumn("_name", R.measurement_field()).where(F.col("_name").isin(fields))
    wide = named.select("host", "ts", *[F.when(F.col("_name") == f, F.col("value")).alias(f) for f in fields])
    return W.ffill_bfill(A.resample_mean(wide, ["host"], step, fields), ["host"], fields)


def ensemble_job(
    points: DataFrame,
    now: Time | None = None,
    days: int = 7,
    metrics: list[str] | None = None,
    params: RiskParams = DEFAULT_RISK,
) -> RiskTables:
    """Hourly ensemble risk of every host."""
    names = metrics or schema.MONITORED_METRICS
    rows = points.where(F.col("field").isin(names))
    if now is not None:
        rows = lookback(rows, now, f"{days} days")
    risk = K.hour_risk(hourly_series(rows), params=params)
    return RiskTables(risk, K.overall_risk(risk, len(names), params=params))


def peak_job(
    points: DataFrame,
    now: Time | None = None,
    days: int = 30,
    metrics: list[str] | None = None,
    params: RiskParams = DEFAULT_RISK,
) -> RiskTables:
    """Peak risk of every host."""
    names = metrics or schema.MONITORED_METRICS
    rows = points.where(F.col("field").isin(names))
    if now is not None:
        rows = lookback(rows, now, f"{days} days")
    risk = K.peak_risk(hourly_series(rows), params=params)
    return RiskTables(risk, K.overall_risk(risk, len(names), params=params))


def disk_failure_job(reports: DataFrame, keys: list[str], text: str = "report") -> DataFrame:
    """Text reports to attributes, scores, health status and line protocol.

    Every report is scored on its own, whatever its keys, and stays in its task.  A report
    without any readable attribute gets the default probability.
    """
    scored = D.score_disks(ST.wide_smart_reports(reports, keys, schema.SMART_SCORE_ATTRIBUTES, text))
    fields = ["failure_probability", *schema.SMART_SCORE_ATTRIBUTES, "health_status"]
    tags = [k for k in keys if k != "ts"]
    return LP.to_line_protocol(scored, "disk_failure", tags, fields)


def forecast_cpu(predictions: DataFrame, horizon: int = 60, version: int = 2) -> DataFrame:
    """Horizon of each host's one-step prediction ``(host, ts, current, mean, prediction)``."""
    if version == 1:
        spread = P.expand_decay(predictions, horizon).withColumn("confidence", F.lit(0.85))
    else:
        spread = P.expand_mean_reverting(predictions, horizon)
        spread = spread.withColumn("confidence", P.confidence(F.lit(horizon)))
    return spread.select("host", "step", "forecast_ts", "current", "prediction", "forecast", "confidence")


def detect_anomalies(points: DataFrame, model, metric_type: str, details: int = 20) -> tuple[DataFrame, DataFrame]:
    """Minute means of the model's fields, scored: summary per host and the first anomalous rows."""
    fields = list(model.features)
    rows = select_points(points, measurement=metric_type, fields=fields)
    means = A.aggregate_window(rows, ["host", "field"], "1m", "mean")
    wide = R.pivot_fields(means, ["host", "ts"], fields, agg="first")
    scored = model.transform(R.feature_policy(wide, fields, "zero"))
    return A.anomaly_summary(scored, ["host"]), W.anomaly_details(scored, ["host"], details)


def latest_smart(smart: DataFrame, now: Time, interval: str = "1 hour") -> DataFrame:
    """Newest SMART reading of every device within the interval, at most one row per device."""
    rows = lookback(smart, now, interval)
    columns = [c for c in smart.columns if c != "device"]
    return A.last_per_series(rows, ["device"], ["ts"], columns)


def disk_outlook(
    devices: DataFrame, smart: DataFrame, model, features: list[str], now: Time, interval: str = "1 hour"
) -> DataFrame:
    """Prediction for every device from its newest reading; without one the default and ``unknown``."""
    readings = latest_smart(smart, now, interval)
    scored = predict_disk(model, readings, features).select(
        "device", "probability", "confidence", "status", "recommendation", "active_attributes"
    )
    joined = devices.select("device").join(scored.withColumn("smart_available", F.lit(True)), "device", "left")
    status = F.coalesce("status", F.lit("unknown"))
    probability = F.coalesce("probability", F.lit(D.DEFAULT_PROBABILITY))
    return joined.select(
        "device",
        probability.alias("probability"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        status.alias("status"),
        F.coalesce("recommendation", X.disk_advice(status, probability)).alias("recommendation"),
        "active_attributes",
        F.coalesce("smart_available", F.lit(False)).alias("smart_available"),
    )


def peak_levels(tables: RiskTables, warning: float, critical: float) -> DataFrame:
    """The overall table with levels under other thresholds."""
    level: Column = X.risk_level(F.col("overall_risk"), warning, critical)
    return tables.overall.withColumn("overall_level", level)
