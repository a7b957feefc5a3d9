"""Scans, parsers, ingest and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators import aggregate as A
from pulsegrid.operators.ordered import union_all
from pulsegrid.operators import disk as D
from pulsegrid.operators import risk as K
from pulsegrid.plans import inputs as I
from pulsegrid.plans import jobs
from pulsegrid.plans.registry import query
from pulsegrid.sources import ingest as G
from pulsegrid.sources import line_protocol as LP
from pulsegrid.sources import points as P
from pulsegrid.sources import sinks as Z
from pulsegrid.sources import smart_text as ST
from pulsegrid.sources.points import hourly_series

r6 = I.r6


@query("scan_range", """
    SELECT event_id, ts, host, measurement, field, value FROM points
    WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'
      AND measurement = 'cpu' AND host = 'h1'""")
def scan_range(spark, sf):
    return P.select_points(I.points(spark, sf), "2024-01-05 00:00:00", "2024-01-20 12:00:00", "cpu", "h1")


@query("default_last_hour", """
    SELECT event_id, ts, host, value FROM points
    WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR AND ts <= (SELECT max(ts) FROM events)""")
def default_last_hour(spark, sf):
    return P.default_range(I.points(spark, sf)).select("event_id", "ts", "host", "value")


@query("lookback_counts", """
    SELECT host, '7 days' AS span, count(*) AS points FROM points
      WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-30' GROUP BY host
    UNION ALL SELECT host, '24 hours', count(*) FROM points
      WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-30' GROUP BY host
    UNION ALL SELECT host, '600 minutes', count(*) FROM points
      WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 600 MINUTE AND ts < TIMESTAMP '2024-01-30' GROUP BY host""")
def lookback_counts(spark, sf):
    rows = I.points(spark, sf)
    parts = []
    for span in ("7 days", "24 hours", "600 minutes"):
        counts = A.point_counts(P.lookback(rows, I.NOW, span), ["host"])
        parts.append(counts.select("host", F.lit(span).alias("span"), "points"))
    return union_all(parts)


@query("union_of_tables", """
    SELECT host, measurement, field, count(*) AS points, round(sum(value), 6) AS total FROM (
      SELECT host, measurement, field, value FROM points
      UNION ALL SELECT host, measurement, field, value FROM app_points) u GROUP BY ALL""")
def union_of_tables(spark, sf):
    both = union_all([I.points(spark, sf), I.app_points(spark, sf)])
    return both.groupBy(*schema.POINT_KEYS).agg(
        F.count(F.lit(1)).alias("points"), r6(F.sum("value")).alias("total")
    )


@query("smart_report_parse", """
    SELECT device, ts, attr, id, 100 AS value, 99 AS worst, 10 AS threshold, raw FROM (
      SELECT device, ts, 'reallocated_sector_ct' AS attr, 1 AS id, CAST(reallocated_sector_ct AS VARCHAR) AS raw FROM smart
      UNION ALL SELECT device, ts, 'pending_sector_ct', 2, CAST(pending_sector_ct AS VARCHAR) FROM smart
      UNION ALL SELECT device, ts, 'uncorrectable_errors', 3, CAST(uncorrectable_errors AS VARCHAR) FROM smart
      UNION ALL SELECT device, ts, 'temperature_celsius', 4,
        CASE WHEN temperature_celsius > 75 THEN 'n/a' ELSE CAST(temperature_celsius AS VARCHAR) END FROM smart
      UNION ALL SELECT device, ts, 'power_on_hours', 5, CAST(power_on_hours AS VARCHAR) FROM smart) a""")
def smart_report_parse(spark, sf):
    return ST.parse_smart_reports(I.smart_reports(spark, sf), ["device", "ts"])


@query("line_protocol_write", """
    SELECT event_id, measurement || ',host=' || host || ' ' || field || '=' || CAST(value AS VARCHAR) || ',unit="pct"'
      || ' ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line
    FROM points WHERE field = 'used_percent'""")
def line_protocol_write(spark, sf):
    rows = I.points(spark, sf).where(F.col("field") == "used_percent")
    rows = rows.withColumnRenamed("value", "used_percent").withColumn("unit", F.lit("pct"))
    out = LP.to_line_protocol(rows, F.col("measurement"), ["host"], ["used_percent", "unit"])
    return out.select("event_id", "line")


@query("line_protocol_read", """
    SELECT event_id, measurement, host, ts, 'used_percent' AS field, value, CAST(NULL AS VARCHAR) AS text
      FROM points WHERE field = 'used_percent'
    UNION ALL SELECT event_id, measurement, host, ts, 'unit', NULL, 'pct' FROM points WHERE field = 'used_percent'""")
def line_protocol_read(spark, sf):
    parsed = LP.parse_line_protocol(line_protocol_write(spark, sf), keep=["event_id"])
    return parsed.select(
        "event_id", "measurement", F.try_element_at("tags", F.lit("host")).alias("host"), "ts", "field", "value", "text"
    )


_MIXED = """SELECT event_id, measurement, host, 'rack ' || CAST(event_id % 3 AS VARCHAR) || ',u=1' AS slot, ts,
      CASE WHEN event_id % 5 <> 0 THEN value END AS load, CASE WHEN event_id % 7 <> 0 THEN event_id * 3 END AS requests,
      event_id % 2 = 0 AS ok, CASE WHEN event_id % 4 <> 0 THEN 'say "' || field || '" \\, a=b' END AS note FROM points"""


def _mixed_rows(spark, sf):
    """Points with fields of four kinds, some null, and characters the format escapes."""
    row = F.col("event_id")
    return I.points(spark, sf).select(
        "event_id", "measurement", "host", F.concat(F.lit("rack "), (row % 3).cast("string"), F.lit(",u=1")).alias("slot"), "ts",
        F.when(row % 5 != 0, F.col("value")).alias("load"), F.when(row % 7 != 0, row * 3).alias("requests"),
        (row % 2 == 0).alias("ok"), F.when(row % 4 != 0, F.concat(F.lit('say "'), "field", F.lit('" \\, a=b'))).alias("note"),
    )


def _mixed_lines(spark, sf):
    rows = _mixed_rows(spark, sf)
    return LP.to_line_protocol(rows, F.col("measurement"), ["host", "slot"], ["load", "requests", "ok", "note"]).select("event_id", "line")


@query("line_protocol_mixed_write", rf"""
    SELECT event_id, measurement || ',host=' || host || ',slot=' || replace(replace(replace(slot, ' ', '\ '), ',', '\,'), '=', '\=') || ' '
      || concat_ws(',', 'load=' || CAST(load AS VARCHAR), 'requests=' || CAST(requests AS VARCHAR) || 'i', 'ok=' || CAST(ok AS VARCHAR),
        'note="' || replace(replace(note, '\', '\\'), '"', '\"') || '"') || ' ' || CAST(epoch_us(ts) * 1000 AS VARCHAR) AS line
    FROM ({_MIXED}) m""")
def line_protocol_mixed_write(spark, sf):
    return _mixed_lines(spark, sf)


@query("line_protocol_mixed_read", f"""
    WITH m AS ({_MIXED})
    SELECT event_id, measurement, host, slot, ts, 'load' AS field, load AS value, CAST(NULL AS VARCHAR) AS text FROM m WHERE load IS NOT NULL
    UNION ALL SELECT event_id, measurement, host, slot, ts, 'requests', requests::DOUBLE, NULL FROM m WHERE requests IS NOT NULL
    UNION ALL SELECT event_id, measurement, host, slot, ts, 'ok', ok::INTEGER::DOUBLE, NULL FROM m
    UNION ALL SELECT event_id, measurement, host, slot, ts, 'note', NULL, note FROM m WHERE note IS NOT NULL""")
def line_protocol_mixed_read(spark, sf):
    parsed = LP.parse_line_protocol(_mixed_lines(spark, sf), keep=["event_id"])
    tags = [F.try_element_at("tags", F.lit(t)).alias(t) for t in ("host", "slot")]
    return parsed.select("event_id", "measurement", *tags, "ts", "field", "value", "text")


def _now():
    return F.lit(I.NOW).cast("timestamp_ntz")


@query("ingest_lenient", """
    SELECT ts, CASE WHEN event_id % 13 <> 0 THEN measurement ELSE 'custom' END AS measurement, host, field, value
    FROM points WHERE event_id % 17 <> 0""")
def ingest_lenient(spark, sf):
    # Rows without fields are accepted; they just hold no point.
    got = G.ingest_metrics(I.submitted(spark, sf), _now(), strict=False).points
    return got.select("ts", "measurement", "host", "field", "value")


@query("ingest_strict_points", """
    SELECT ts, measurement, host, field, value FROM (
      SELECT *, count(*) OVER (PARTITION BY event_id // 1500) AS size FROM points) p
    WHERE event_id % 17 <> 0 AND event_id % 13 <> 0 AND size <= 1000""")
def ingest_strict_points(spark, sf):
    got = G.ingest_metrics(I.submitted(spark, sf), _now(), strict=True).points
    return got.select("ts", "measurement", "host", "field", "value")


@query("ingest_strict_rejects", """
    SELECT CAST(event_id // 1500 AS BIGINT) AS batch_id, event_id AS index,
      CASE WHEN size > 1000 THEN 'more than 1000 metrics in the batch' ELSE 'missing required fields' END AS reason
    FROM (SELECT *, count(*) OVER (PARTITION BY event_id // 1500) AS size FROM points) p
    WHERE size > 1000 OR event_id % 17 = 0 OR event_id % 13 = 0""")
def ingest_strict_rejects(spark, sf):
    return G.ingest_metrics(I.submitted(spark, sf), _now(), strict=True).rejects


@query("ingest_strict_counts", """
    SELECT CAST(event_id // 1500 AS BIGINT) AS batch_id,
      count(*) FILTER (size <= 1000 AND event_id % 17 <> 0 AND event_id % 13 <> 0) AS points_written,
      count(*) FILTER (size > 1000 OR event_id % 17 = 0 OR event_id % 13 = 0) AS errors
    FROM (SELECT *, count(*) OVER (PARTITION BY event_id // 1500) AS size FROM points) p GROUP BY 1""")
def ingest_strict_counts(spark, sf):
    return G.ingest_metrics(I.submitted(spark, sf), _now(), strict=True).counts


@query("peak_sink_points", """
    SELECT TIMESTAMP '2024-01-30' + to_hours(CAST(hour AS INTEGER)) AS ts, 'anomaly_predictions' AS measurement, host,
      CAST(NULL AS VARCHAR) AS metric, field, value FROM (
        SELECT host, hour, 'overall_risk_score' AS field, round(overall_risk, 6) AS value FROM peak_overall
        UNION ALL SELECT host, hour, 'risk_level_numeric',
          CASE WHEN overall_risk > 0.7 THEN 2 WHEN overall_risk > 0.5 THEN 1 ELSE 0 END FROM peak_overall) o
    UNION ALL
    SELECT TIMESTAMP '2024-01-30' + to_hours(CAST(hour AS INTEGER)), 'metric_predictions', host, metric, field, value FROM (
        SELECT host, metric, hour, 'risk_score' AS field, round(risk, 6) AS value FROM peak_table
        UNION ALL SELECT host, metric, hour, 'risk_level_numeric',
          CASE WHEN risk > 0.7 THEN 2 WHEN risk > 0.5 THEN 1 ELSE 0 END FROM peak_table
        UNION ALL SELECT host, metric, hour, 'historical_max', round(hist_max, 6) FROM peak_table
        UNION ALL SELECT host, metric, hour, 'historical_min', round(hist_min, 6) FROM peak_table
        UNION ALL SELECT host, metric, hour, 'expected_value', round(profile, 6) FROM peak_table) m""")
def peak_sink_points(spark, sf):
    tables = jobs.peak_job(I.app_points(spark, sf))
    out = Z.peak_to_points(tables.risk, tables.overall, _now(), 30)
    return out.select(
        "ts", "measurement", "host", F.try_element_at("tags", F.lit("metric")).alias("metric"),
        "field", r6("value").alias("value"),
    )


@query("prediction_sink_points", """
    WITH p AS (
      SELECT host, max(ts) AS ts, arg_max(value, (ts, event_id)) AS cpu, avg(CASE WHEN value > 90 THEN 1 ELSE 0 END) AS rate,
        count(*) FILTER (value > 90) AS cnt FROM points GROUP BY host),
    d AS (SELECT concat('h', CAST(device % 4 AS VARCHAR)) AS host, max(failure_probability) AS prob FROM disk_scored GROUP BY 1),
    j AS (SELECT p.*, d.prob FROM p LEFT JOIN d USING (host))
    SELECT ts, 'prediction' AS measurement, host, 'value' AS field, round(cpu, 6) AS value FROM j
    UNION ALL SELECT ts, 'anomaly', host, 'rate', round(rate, 6) FROM j
    UNION ALL SELECT ts, 'anomaly', host, 'count', cnt FROM j
    UNION ALL SELECT ts, 'anomaly', host, 'threshold', 0.25 FROM j
    UNION ALL SELECT ts, 'disk_failure', host, 'probability', round(prob, 6) FROM j WHERE prob IS NOT NULL
    UNION ALL SELECT ts, 'disk_failure', host, 'above_threshold', CASE WHEN prob > 0.8 THEN 1 ELSE 0 END FROM j
      WHERE prob IS NOT NULL""")
def prediction_sink_points(spark, sf):
    hot = F.col("value") > 90
    per_host = I.points(spark, sf).groupBy("host").agg(
        F.max("ts").alias("ts"),
        F.max_by("value", F.struct("ts", "event_id")).alias("cpu_prediction"),
        F.avg(hot.cast("int")).alias("anomaly_rate"),
        F.count_if(hot).alias("anomaly_count"),
    )
    disks = D.score_disks(I.smart(spark, sf)).withColumn("host", F.concat(F.lit("h"), (F.col("device") % 4).cast("string")))
    worst = disks.groupBy("host").agg(F.max("failure_probability").alias("disk_probability"))
    rows = per_host.join(worst, "host", "left").withColumns(
        {"anomaly_threshold": F.lit(0.25), "disk_threshold": F.lit(0.8)}
    )
    return Z.predictions_to_points(rows).select("ts", "measurement", "host", "field", r6("value").alias("value"))


@query("alert_sink_rows", """
    SELECT ts, host, metric, value, threshold, severity, 'active' AS status, CAST(ts AS DATE) AS day FROM alerts""")
def alert_sink_rows(spark, sf):
    from pulsegrid.operators.alerts import to_alerts
    from pulsegrid.session import shared_dir

    path = shared_dir(spark, "alert-sink")
    Z.write_alerts(to_alerts(I.alerts(spark, sf), ["id"]), path)
    return spark.read.parquet(path).select("ts", "host", "metric", "value", "threshold", "severity", "status", "day")


@query("training_sink_points", """
    WITH e AS (SELECT value - prev AS err FROM (
      SELECT value, lag(value) OVER (PARTITION BY host, metric ORDER BY ts) AS prev FROM series) s WHERE prev IS NOT NULL)
    SELECT TIMESTAMP '2024-01-30' AS ts, 'ml_training' AS measurement, 'ml_pipeline' AS host, field, value FROM (
      SELECT 'naive_mae' AS field, round(avg(abs(err)), 6) AS value FROM e
      UNION ALL SELECT 'naive_mse', round(avg(err * err), 6) FROM e) x""")
def training_sink_points(spark, sf):
    pairs = _naive_pairs(spark, sf)
    errors = A.regression_metrics(pairs, [], "value", "forecast").unpivot([], ["mae", "mse"], "metric", "value")
    out = Z.results_to_points(errors.withColumn("model", F.lit("naive")), _now())
    return out.select("ts", "measurement", "host", "field", r6("value").alias("value"))


def _naive_pairs(spark, sf):
    """Each hourly value with the one before as its forecast."""
    from pyspark.sql import Window

    spec = Window.partitionBy("host", "metric").orderBy("ts")
    return I.series(spark, sf).withColumn("forecast", F.lag("value").over(spec))


@query("flat_prediction_rows", """
    SELECT host, TIMESTAMP '2024-01-30' + to_hours(CAST(hour AS INTEGER)) AS "timestamp", CAST(hour AS INTEGER) AS hour, metric,
      CASE WHEN risk > 0.7 THEN 'critical' WHEN risk > 0.5 THEN 'warning' ELSE 'normal' END AS risk_level, trend,
      round(risk, 3) AS risk_score, round(r2, 3) AS trend_confidence,
      round(zscore, 3) AS method_zscore, round(iqr, 3) AS method_iqr,
      round(ma, 3) AS method_ma, round(ewma_s, 3) AS method_ewma, 0::DOUBLE AS method_pattern FROM risk_table""")
def flat_prediction_rows(spark, sf):
    tables = jobs.ensemble_job(I.app_points(spark, sf))
    # expected values are means of short decimals that often lie on a boundary of two decimals
    return Z.flat_predictions(tables.risk, _now()).drop("expected_value")


@query("summary_hours", """
    SELECT host, count(*) AS total_hours, count(*) FILTER (overall_risk > 0.3) AS critical_hours,
      count(*) FILTER (overall_risk > 0.2 AND overall_risk <= 0.3) AS warning_hours,
      coalesce(string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) FILTER (overall_risk >= 0.2), '') AS risky
    FROM overall_table GROUP BY host""")
def summary_hours(spark, sf):
    tables = jobs.ensemble_job(I.app_points(spark, sf))
    overall = jobs.peak_levels(tables, 0.2, 0.3)
    rows = Z.summary_rows(overall, 0.2)
    hours = F.transform("high_risk_periods", lambda p: p["hour"].cast("string"))
    return rows.select("host", "total_hours", "critical_hours", "warning_hours", F.array_join(hours, ",").alias("risky"))


@query("disk_report_to_line_protocol", """
    SELECT device, 'disk_failure,device=' || CAST(device AS VARCHAR) || ' failure_probability=' AS head,
      round(CASE WHEN w = 0 THEN 0.05 ELSE least(s / w, 0.95) END, 9) AS probability, epoch_us(ts) * 1000 AS ns FROM (
        SELECT device, ts,
          CASE WHEN reallocated_sector_ct > 0 THEN least(reallocated_sector_ct / 100, 1) * 0.4 ELSE 0 END
          + CASE WHEN pending_sector_ct > 0 THEN least(pending_sector_ct / 50, 1) * 0.3 ELSE 0 END
          + CASE WHEN uncorrectable_errors > 0 THEN least(uncorrectable_errors / 10, 1) * 0.2 ELSE 0 END
          + CASE WHEN temperature_celsius BETWEEN 61 AND 75 THEN least((temperature_celsius - 60) / 40, 1) * 0.1 ELSE 0 END
          + CASE WHEN power_on_hours > 20000 THEN least((power_on_hours - 20000) / 40000, 1) * 0.1 ELSE 0 END AS s,
          CASE WHEN reallocated_sector_ct > 0 THEN 0.4::DOUBLE ELSE 0 END
          + CASE WHEN pending_sector_ct > 0 THEN 0.3::DOUBLE ELSE 0 END
          + CASE WHEN uncorrectable_errors > 0 THEN 0.2::DOUBLE ELSE 0 END
          + CASE WHEN temperature_celsius BETWEEN 61 AND 75 THEN 0.1::DOUBLE ELSE 0 END
          + CASE WHEN power_on_hours > 20000 THEN 0.1::DOUBLE ELSE 0 END AS w
        FROM smart) x""")
def disk_report_to_line_protocol(spark, sf):
    lines = jobs.disk_failure_job(I.smart_reports(spark, sf), ["device", "ts"])
    line = F.col("line")
    return lines.select(
        "device",
        F.regexp_extract(line, r"^(.*?failure_probability=)", 1).alias("head"),
        F.round(F.regexp_extract(line, r"failure_probability=([^, ]+)", 1).cast("double"), 9).alias("probability"),
        F.regexp_extract(line, r" (\d+)$", 1).cast("bigint").alias("ns"),
    )


@query("point_counts", "SELECT measurement, field, count(*) AS points FROM points GROUP BY ALL")
def point_counts(spark, sf):
    return A.point_counts(I.points(spark, sf), ["measurement", "field"])


@query("hourly_series", """
    SELECT host, metric, ts, round(value, 6) AS value FROM series""")
def hourly(spark, sf):
    return hourly_series(I.app_points(spark, sf)).withColumn("value", r6("value"))


@query("epoch_conversions", """
    SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS seconds, epoch_us(ts) * 1000 AS nanos,
      date_trunc('second', ts) AS back FROM events""")
def epoch_conversions(spark, sf):
    rows = I.table(spark, sf, "events")
    seconds = X.epoch_seconds(F.col("ts"))
    return rows.select(
        "event_id", seconds.alias("seconds"), X.epoch_nanos(F.col("ts")).alias("nanos"),
        X.from_epoch_seconds(seconds).alias("back"),
    )


@query("parse_iso_times", """
    SELECT event_id, ts, CAST(NULL AS TIMESTAMP) AS bad FROM events""")
def parse_iso_times(spark, sf):
    rows = I.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return rows.select(
        "event_id", X.parse_ts(text).alias("ts"), X.parse_ts(F.concat(F.lit("x"), text)).alias("bad")
    )
