"""Report content as rows: ``(host, section, ord, key, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators import aggregate as A
from pulsegrid.operators import windows as W
from pulsegrid.operators.ordered import union_all
from pulsegrid.schema import DEFAULT_RISK, RiskParams


def recommendation_code(critical_hours: Column, warning_hours: Column) -> Column:
    return (
        F.when(critical_hours > 0, "act_on_critical_hours")
        .when(warning_hours > 0, "watch_warning_hours")
        .otherwise("keep_monitoring")
    )


def report_rows(
    risk: DataFrame, overall: DataFrame, params: RiskParams = DEFAULT_RISK, methods: bool = True
) -> DataFrame:
    """Summary, risky hours, their main metrics, metric averages, methods and the advice, per host."""
    summary = A.risk_summary(overall, ["host"])
    counts = ["total_hours", "critical_hours", "warning_hours"]
    order = F.when(F.col("key") == counts[0], 0).when(F.col("key") == counts[1], 1).otherwise(2)
    doubles = summary.select("host", *[F.col(c).cast("double").alias(c) for c in counts])
    parts = [
        doubles.unpivot(["host"], counts, "key", "value").select(
            "host", F.lit("summary").alias("section"), order.alias("ord"), "key", "value"
        )
    ]
    risky = A.high_risk(overall, params.warning)
    hour = F.lpad(F.col("hour").cast("string"), 2, "0")
    parts.append(
        risky.select(
            "host", F.lit("high_risk_hour").alias("section"), F.col("hour").alias("ord"),
            F.concat(hour, F.lit(" "), F.col("overall_level")).alias("key"), F.col("overall_risk").alias("value"),
        )
    )
    contributors = W.top_contributors(risk).join(risky.select("host", "hour"), ["host", "hour"], "left_semi")
    parts.append(
        contributors.select(
            "host", F.lit("contributor").alias("section"), F.col("hour").alias("ord"),
            F.concat(hour, F.lit(" "), F.col("metric")).alias("key"), F.col("risk").alias("value"),
        )
    )
    by_metric = A.metric_risk(risk)
    position = F.row_number().over(Window.partitionBy("host").orderBy("metric")) - 1
    parts.append(
        by_metric.select(
            "host", F.lit("metric_average").alias("section"), position.alias("ord"),
            F.col("metric").alias("key"), F.col("avg_risk").alias("value"),
        )
    )
    if methods:
        contribution = A.method_contribution(risk, ["host"], params.weights)
        position = F.row_number().over(Window.partitionBy("host").orderBy("method")) - 1
        parts.append(
            contribution.select(
                "host", F.lit("method_average").alias("section"), position.alias("ord"),
                F.col("method").alias("key"), F.col("avg_score").alias("value"),
            )
        )
    parts.append(
        summary.select(
            "host", F.lit("recommendation").alias("section"), F.lit(0).alias("ord"),
            recommendation_code(F.col("critical_hours"), F.col("warning_hours")).alias("key"),
            F.lit(None).cast("double").alias("value"),
        )
    )
    return union_all(parts)
