"""Telemetry views over the benchmark tables, in Spark and as SQL text for the oracle.

The tables stand in for telemetry: ``events`` for metric points, alerts and
requests, ``lineitem`` for SMART readings.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.sources.points import hourly_series

NOW = "2024-01-30 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Two engines add in different orders, so results differ in the last digits and are
# compared at six decimals.  Means of short decimals often end exactly on a rounding
# boundary (48.5046875), where the last digit would decide; this shift moves the
# boundaries to where such values never lie.
SHIFT = 0.4142


def r6(value: Column | str) -> Column:
    """The value at six decimals, see ``SHIFT``."""
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column * 1e6 + SHIFT) / 1e6


def _r6_sql(sql: str) -> str:
    """``round(x, 6)`` in a statement written as ``r6`` computes it."""
    at = sql.find("round(")
    while at >= 0:
        start, depth, commas = at + len("round("), 1, []
        i = start
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                commas.append(i)
            i += 1
        inner, digits = sql[start : commas[-1]], sql[commas[-1] + 1 : i - 1].strip()
        if digits == "6":
            sql = f"{sql[:at]}(floor(({inner}) * 1e6 + {SHIFT}) / 1e6){sql[i:]}"
            at = sql.find("round(", at)
        else:
            at = sql.find("round(", at + 1)
    return sql


def _host(number: str) -> Column:
    return F.concat(F.lit("h"), (F.col(number) % 4).cast("string"))


def _choose(column: str, options: dict[str, str | Column], otherwise: str | Column) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for value, result in options.items():
        out = F.when(F.col(column) == value, F.lit(result) if isinstance(result, str) else result).otherwise(out)
    return out


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent points: percentages by measurement and field."""
    return points_of(table(spark, sf_dir, "events"))


def points_of(events: DataFrame) -> DataFrame:
    """Agent points of a table or stream of events."""
    even = F.col("event_id") % 2 == 0
    measurement = _choose(
        "event_type", {"click": "cpu", "view": "mem", "purchase": "disk", "signup": "net"}, "system"
    )
    field = _choose(
        "event_type",
        {
            "click": F.when(even, "usage_user").otherwise("usage_system"),
            "view": "used_percent",
            "purchase": "used_percent",
            "signup": F.when(even, "bytes_recv").otherwise("bytes_sent"),
        },
        "load1",
    )
    return events.select(
        "event_id", "ts", _host("user_id").alias("host"), measurement.alias("measurement"),
        field.alias("field"), F.least("value", F.lit(100.0)).alias("value"),
    )


def tagged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent points with the tags of one of three devices."""
    device = F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"))
    return points(spark, sf_dir).withColumn("tags", F.create_map(F.lit("host"), F.col("host"), F.lit("device"), device))


def app_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five monitored metrics, raw values."""
    field = _choose(
        "event_type",
        {"click": "cpu_usage", "view": "memory_usage", "purchase": "disk_usage", "signup": "network_rx"},
        "network_tx",
    )
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", _host("user_id").alias("host"), F.lit("system_metrics").alias("measurement"),
        field.alias("field"), "value",
    )


def raw_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw points keyed as series."""
    return app_points(spark, sf_dir).select("event_id", "host", F.col("field").alias("metric"), "ts", "value")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly means per host and metric."""
    return hourly_series(app_points(spark, sf_dir))


def smart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMART readings per device and time, with a failure label."""
    line, qty = F.col("l_linenumber"), F.col("l_quantity")

    def largest(condition: Column | None, value: Column) -> Column:
        whole = F.floor(value).cast("bigint")
        return F.max(whole if condition is None else F.when(condition, whole).otherwise(0))

    failed = (qty > 40) & (F.col("l_discount") >= 0.05)
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("device"), F.col("l_shipdate").alias("ts"))
    return grouped.agg(
        largest(line <= 2, qty * 4).alias("reallocated_sector_ct"),
        largest(line == 3, qty).alias("pending_sector_ct"),
        largest(F.col("l_returnflag") == "R", F.col("l_tax") * 100 + 0.5).alias("uncorrectable_errors"),
        largest(None, qty + 30).alias("temperature_celsius"),
        largest(None, F.col("l_extendedprice")).alias("power_on_hours"),
        F.max(F.when(failed, 1).otherwise(0)).alias("failed"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    severity = F.when(value > 200, "critical").when(value > 150, "warning").otherwise("info")
    return (
        table(spark, sf_dir, "events")
        .where((F.col("event_type") == "error") & (value > 100))
        .select(
            F.col("event_id").alias("id"), "ts", _host("user_id").alias("host"), F.lit("error_value").alias("metric"),
            "value", F.lit(100.0).alias("threshold"), severity.alias("severity"),
            F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("active").alias("status"),
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request log: one request per event."""
    return table(spark, sf_dir, "events").select("event_id", "ts", _host("user_id").alias("client"))


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted metrics as JSON; one in 17 lacks its fields, one in 13 its measurement."""
    fields = F.when(F.col("event_id") % 17 != 0, F.create_map(F.col("field"), F.col("value")))
    measurement = F.when(F.col("event_id") % 13 != 0, F.col("measurement"))
    body = F.to_json(
        F.struct(
            measurement.alias("measurement"),
            F.create_map(F.lit("host"), F.col("host")).alias("tags"),
            fields.alias("fields"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        )
    )
    return points(spark, sf_dir).select(
        F.floor(F.col("event_id") / 1500).cast("bigint").alias("batch_id"), F.col("event_id").alias("index"),
        body.alias("json"),
    )


def smart_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text report per device and time; hot disks report their temperature as ``n/a``."""
    names = ["Reallocated_Sector_Ct", "Pending_Sector_Ct", "Uncorrectable_Errors", "Temperature_Celsius", "Power_On_Hours"]
    lines = [F.lit("=== START OF READ SMART DATA SECTION ==="),
             F.lit("ID# ATTRIBUTE_NAME FLAG VALUE WORST THRESH TYPE UPDATED WHEN_FAILED RAW_VALUE")]
    for number, name in enumerate(names, start=1):
        raw = F.col(name.lower()).cast("string")
        if name == "Temperature_Celsius":
            raw = F.when(F.col("temperature_celsius") > 75, "n/a").otherwise(raw)
        lines.append(F.concat_ws(" ", F.lit(f"  {number} {name} 0x0032 100 099 010 Old_age Always  -"), raw))
    lines.append(F.lit("not an attribute line"))
    return smart(spark, sf_dir).select("device", "ts", F.concat_ws("\n", *lines).alias("report"))


# ---- the same views as SQL --------------------------------------------------------------
VIEWS: dict[str, str] = {
    "points": """
        SELECT event_id, ts, concat('h', CAST(user_id % 4 AS VARCHAR)) AS host,
          CASE event_type WHEN 'click' THEN 'cpu' WHEN 'view' THEN 'mem' WHEN 'purchase' THEN 'disk'
            WHEN 'signup' THEN 'net' ELSE 'system' END AS measurement,
          CASE event_type
            WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'usage_user' ELSE 'usage_system' END
            WHEN 'view' THEN 'used_percent' WHEN 'purchase' THEN 'used_percent'
            WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'bytes_recv' ELSE 'bytes_sent' END
            ELSE 'load1' END AS field,
          least(value, CAST(100 AS DOUBLE)) AS value
        FROM events""",
    "tagged_points": """
        SELECT *, concat('device=d', CAST(event_id % 3 AS VARCHAR), ',host=', host) AS tag_set FROM points""",
    "app_points": """
        SELECT event_id, ts, concat('h', CAST(user_id % 4 AS VARCHAR)) AS host, 'system_metrics' AS measurement,
          CASE event_type WHEN 'click' THEN 'cpu_usage' WHEN 'view' THEN 'memory_usage'
            WHEN 'purchase' THEN 'disk_usage' WHEN 'signup' THEN 'network_rx' ELSE 'network_tx' END AS field, value
        FROM events""",
    "series": """
        SELECT host, field AS metric, date_trunc('hour', ts) AS ts, avg(value) AS value
        FROM app_points GROUP BY ALL""",
    "smart": """
        SELECT l_suppkey AS device, l_shipdate AS ts,
          max(CASE WHEN l_linenumber <= 2 THEN CAST(floor(l_quantity * 4) AS BIGINT) ELSE 0 END) AS reallocated_sector_ct,
          max(CASE WHEN l_linenumber = 3 THEN CAST(floor(l_quantity) AS BIGINT) ELSE 0 END) AS pending_sector_ct,
          max(CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_tax * 100 + 0.5) AS BIGINT) ELSE 0 END) AS uncorrectable_errors,
          max(CAST(floor(l_quantity + 30) AS BIGINT)) AS temperature_celsius,
          max(CAST(floor(l_extendedprice) AS BIGINT)) AS power_on_hours,
          max(CASE WHEN l_quantity > 40 AND l_discount >= 0.05 THEN 1 ELSE 0 END) AS failed
        FROM lineitem GROUP BY ALL""",
    "alerts": """
        SELECT event_id AS id, ts, concat('h', CAST(user_id % 4 AS VARCHAR)) AS host, 'error_value' AS metric, value,
          CAST(100 AS DOUBLE) AS threshold,
          CASE WHEN value > 200 THEN 'critical' WHEN value > 150 THEN 'warning' ELSE 'info' END AS severity,
          CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'active' END AS status
        FROM events WHERE event_type = 'error' AND value > 100""",
    "requests": """
        SELECT event_id, ts, concat('h', CAST(user_id % 4 AS VARCHAR)) AS client FROM events""",
    # --- tables of the risk chain, for the oracle only ---
    "numbered": """
        SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts) - 1 AS rn,
          count(*) OVER (PARTITION BY host, metric) AS n FROM series""",
    "baseline0": """
        SELECT host, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
          quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
          avg(value) FILTER (rn >= n - 7) AS ma_mean, stddev_pop(value) FILTER (rn >= n - 7) AS ma_std,
          list(value ORDER BY ts) AS vals, var_pop(value) FILTER (rn < 10) AS v0,
          regr_slope(value, CAST(rn AS DOUBLE)) AS fit_slope, regr_r2(value, CAST(rn AS DOUBLE)) AS fit_r2
        FROM numbered GROUP BY host, metric""",
    "baseline1": """
        SELECT *, list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS ewma FROM baseline0""",
    "baseline": """
        SELECT *, sqrt(list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * (x - ewma) * (x - ewma), v0)) AS ewma_std,
          CASE WHEN n >= 10 THEN fit_slope ELSE 0 END AS slope,
          CASE WHEN n >= 10 AND std <> 0 THEN fit_r2 ELSE 0 END AS r2,
          CASE WHEN n < 10 THEN 'stable' WHEN abs(fit_slope) < 0.01 * mean THEN 'stable'
            WHEN fit_slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
        FROM baseline1""",
    "hours": """
        SELECT host, metric, hour(ts) AS hour, count(*) AS hour_n, avg(value) AS hour_mean, stddev_pop(value) AS hour_std
        FROM series GROUP BY ALL""",
    "slots": """
        SELECT b.* EXCLUDE (vals), s.hour, h.hour_n, h.hour_mean, h.hour_std, coalesce(h.hour_mean, b.mean) AS cur
        FROM baseline b CROSS JOIN (SELECT unnest(range(24)) AS hour) s
        LEFT JOIN hours h ON h.host = b.host AND h.metric = b.metric AND h.hour = s.hour""",
    "slot_scores": """
        SELECT *,
          CASE WHEN n < 3 OR std = 0 THEN 0 ELSE least(abs(cur - mean) / std / 5, 1) END AS zscore,
          CASE WHEN n < 4 OR q3 = q1 THEN 0
            WHEN cur < q1 - 1.5 * (q3 - q1) THEN least((q1 - 1.5 * (q3 - q1) - cur) / (q3 - q1) / 1.5, 1)
            WHEN cur > q3 + 1.5 * (q3 - q1) THEN least((cur - q3 - 1.5 * (q3 - q1)) / (q3 - q1) / 1.5, 1)
            ELSE 0 END AS iqr,
          CASE WHEN n < 7 OR ma_std = 0 THEN 0 ELSE least(abs(cur - ma_mean) / ma_std / 4, 1) END AS ma,
          CASE WHEN n < 3 OR ewma_std = 0 THEN 0 ELSE least(abs(cur - ewma) / ewma_std / 3, 1) END AS ewma_s
        FROM slots""",
    "risk0": """
        SELECT *, 0.25::DOUBLE * zscore + 0.2::DOUBLE * iqr + 0.25::DOUBLE * ma + 0.2::DOUBLE * ewma_s AS ens FROM slot_scores""",
    "risk_table": """
        SELECT *, least(ens + CASE WHEN trend = 'increasing' AND r2 > 0.5 THEN 0.1::DOUBLE ELSE 0 END, 1) AS risk FROM risk0""",
    "overall_table": """
        SELECT host, hour, sum(risk) / 5 AS overall_risk,
          CASE WHEN sum(risk) / 5 > 0.7 THEN 'critical' WHEN sum(risk) / 5 > 0.5 THEN 'warning' ELSE 'normal' END AS overall_level
        FROM risk_table GROUP BY host, hour""",
    "profile": """
        SELECT b.host, b.metric, s.hour, coalesce(h.hour_mean, 0) AS profile
        FROM (SELECT DISTINCT host, metric FROM series) b CROSS JOIN (SELECT unnest(range(24)) AS hour) s
        LEFT JOIN hours h ON h.host = b.host AND h.metric = b.metric AND h.hour = s.hour""",
    "peaks": """
        SELECT host, metric, max(value) AS hist_max, min(value) AS hist_min,
          date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS days
        FROM series GROUP BY host, metric""",
    "peak_slots": """
        SELECT p.*, k.hist_max, k.hist_min, k.days,
          row_number() OVER (PARTITION BY p.host, p.metric ORDER BY profile DESC, hour DESC) - 1 AS hour_rank
        FROM profile p JOIN peaks k ON k.host = p.host AND k.metric = p.metric""",
    "peak_factors": """
        SELECT *, CASE WHEN hist_max > 0 THEN profile / hist_max * 0.5 END AS f_max,
          CASE WHEN hist_min > 0 AND profile > 0 THEN least((profile - hist_min) / hist_min, 1) * 0.3 END AS f_min,
          CASE WHEN days >= 3 THEN hour_rank / 24 * 0.2 END AS f_hour
        FROM peak_slots""",
    "peak_table": """
        SELECT *, coalesce(list_avg(list_filter([f_max, f_min, f_hour], lambda x: x IS NOT NULL)), 0) AS risk
        FROM peak_factors""",
    "peak_overall": """
        SELECT host, hour, sum(risk) / 5 AS overall_risk FROM peak_table GROUP BY host, hour""",
    "disk_scored": """
        SELECT *, CASE WHEN w = 0 THEN 0.05 ELSE least(s / w, 0.95) END AS failure_probability FROM (
          SELECT *,
            CASE WHEN reallocated_sector_ct > 0 THEN least(reallocated_sector_ct / 100, 1) * 0.4 ELSE 0 END
            + CASE WHEN pending_sector_ct > 0 THEN least(pending_sector_ct / 50, 1) * 0.3 ELSE 0 END
            + CASE WHEN uncorrectable_errors > 0 THEN least(uncorrectable_errors / 10, 1) * 0.2 ELSE 0 END
            + CASE WHEN temperature_celsius > 60 THEN least((temperature_celsius - 60) / 40, 1) * 0.1 ELSE 0 END
            + CASE WHEN power_on_hours > 20000 THEN least((power_on_hours - 20000) / 40000, 1) * 0.1 ELSE 0 END AS s,
            CASE WHEN reallocated_sector_ct > 0 THEN 0.4::DOUBLE ELSE 0 END
            + CASE WHEN pending_sector_ct > 0 THEN 0.3::DOUBLE ELSE 0 END
            + CASE WHEN uncorrectable_errors > 0 THEN 0.2::DOUBLE ELSE 0 END
            + CASE WHEN temperature_celsius > 60 THEN 0.1::DOUBLE ELSE 0 END
            + CASE WHEN power_on_hours > 20000 THEN 0.1::DOUBLE ELSE 0 END AS w
          FROM smart)""",
}


def with_views(sql: str) -> str:
    """The statement with the views it names, and those they name, in front as CTEs."""
    sql = _r6_sql(sql)
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:].lstrip()}"
    return f"WITH {ctes}\n{body}"
