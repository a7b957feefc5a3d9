"""Results to points, alerts, CSV and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions.expressions import level_num
from pulsegrid.operators import aggregate as A
from pulsegrid.operators.ordered import union_all


def append_points(points: DataFrame, path: str, ts: str = "ts") -> None:
    """Append to a parquet table partitioned by day.

    The rebalance hint lets adaptive execution split a crowded day over several
    files and put quiet days together.
    """
    daily = points.withColumn("day", F.to_date(ts))
    daily.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def write_alerts(alerts: DataFrame, path: str) -> None:
    columns = [f.name for f in schema.ALERTS.fields]
    append_points(alerts.select(*columns), path)


def _tags(**tags: Column) -> Column:
    entries = []
    for name, value in tags.items():
        entries += [F.lit(name), value.cast("string")]
    return F.create_map(*entries)


def _points(df: DataFrame, measurement: str, tags: Column, fields: dict[str, Column]) -> DataFrame:
    """Long points from ``(host, ts)`` rows; null fields are left out."""
    values = F.array(
        *[F.struct(F.lit(n).alias("field"), c.cast("double").alias("value")) for n, c in fields.items()]
    )
    long = df.select(
        "ts", F.lit(measurement).alias("measurement"), "host", tags.alias("tags"), F.explode(values).alias("_f")
    )
    return long.select("ts", "measurement", "host", "tags", "_f.field", "_f.value").where(
        F.col("value").isNotNull()
    )


def peak_to_points(risk: DataFrame, overall: DataFrame, day: Column, lookback_days: int) -> DataFrame:
    """Hourly records of a peak prediction: one overall, one per metric, at the slot's time on ``day``."""
    slot = (day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))).alias("ts")
    kind = F.lit("peak_based")
    whole = _points(
        overall.withColumn("ts", slot),
        "anomaly_predictions",
        _tags(prediction_type=kind, lookback_days=F.lit(lookback_days)),
        {
            "overall_risk_score": F.col("overall_risk"),
            "risk_level_numeric": level_num(F.col("overall_level")),
        },
    )
    single = _points(
        risk.withColumn("ts", slot),
        "metric_predictions",
        _tags(metric=F.col("metric"), prediction_type=kind),
        {
            "risk_score": F.col("risk"),
            "risk_level_numeric": level_num(F.col("level")),
            "historical_max": F.col("hist_max"),
            "historical_min": F.col("hist_min"),
            "expected_value": F.col("expected"),
        },
    )
    return union_all([whole, single])


def predictions_to_points(pred: DataFrame) -> DataFrame:
    """CPU prediction, anomaly summary and disk probability of each host.

    Expects ``host, ts`` and, as available, ``cpu_prediction``, ``anomaly_rate``,
    ``anomaly_count``, ``anomaly_threshold``, ``disk_probability``,
    ``disk_threshold``.
    """
    null = F.lit(None).cast("double")

    def col(name: str) -> Column:
        return F.col(name) if name in pred.columns else null

    above = (col("disk_probability") > col("disk_threshold")).cast("int")
    return union_all(
        [
            _points(pred, "prediction", _tags(metric=F.lit("cpu_usage"), model=F.lit("sequence")),
                    {"value": col("cpu_prediction")}),
            _points(pred, "anomaly", _tags(metric=F.lit("composite")),
                    {"rate": col("anomaly_rate"), "count": col("anomaly_count"),
                     "threshold": col("anomaly_threshold")}),
            _points(pred, "disk_failure", _tags(metric=F.lit("failure_probability")),
                    {"probability": col("disk_probability"), "above_threshold": above}),
        ]
    )


def forecasts_to_points(forecasts: DataFrame, metric: str) -> DataFrame:
    """Seasonal forecasts ``(host, ts, prediction, lower_bound, upper_bound)`` of one metric."""
    names = ("prediction", "lower_bound", "upper_bound")
    return _points(forecasts, "forecast", _tags(metric=F.lit(metric), model=F.lit("seasonal")), {n: F.col(n) for n in names})


def results_to_points(results: DataFrame, now: Column) -> DataFrame:
    """Evaluation rows ``(model, metric, value)`` as fields ``model_metric``."""
    return results.select(
        now.alias("ts"),
        F.lit("ml_training").alias("measurement"),
        F.lit("ml_pipeline").alias("host"),
        _tags(pipeline=F.lit("training")).alias("tags"),
        F.concat_ws("_", "model", "metric").alias("field"),
        F.col("value").cast("double").alias("value"),
    )


def flat_predictions(risk: DataFrame, day: Column) -> DataFrame:
    """One row per hour and metric with ``method_*`` columns, rounded for reading."""
    slot = day.cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return risk.select(
        "host",
        slot.alias("timestamp"),
        "hour",
        "metric",
        F.round("risk", 3).alias("risk_score"),
        F.col("level").alias("risk_level"),
        "trend",
        F.round("r2", 3).alias("trend_confidence"),
        F.round("expected", 2).alias("expected_value"),
        *[F.round(m, 3).alias(f"method_{m}") for m in schema.METHODS],
    )


def export_csv(risk: DataFrame, day: Column, path: str) -> None:
    flat_predictions(risk, day).write.mode("error").option("header", True).csv(path)


def summary_rows(overall: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per host the hour counts and the list of hours at or above the threshold (at most 24)."""
    slot = F.struct("hour", F.col("overall_risk").alias("risk_score"), F.col("overall_level").alias("risk_level"))
    listed = overall.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(F.col("overall_risk") >= threshold, slot))).alias("high_risk_periods")
    )
    return A.risk_summary(overall, ["host"]).join(listed, "host")


def export_summary_json(overall: DataFrame, path: str, lookback_days: int, threshold: float = 0.5) -> None:
    out = summary_rows(overall, threshold).withColumn("lookback_days", F.lit(lookback_days))
    out.write.mode("error").json(path)
