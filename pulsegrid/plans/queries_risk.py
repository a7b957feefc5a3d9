"""Scorers, risk tables, disk scores, forecasts, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import scores as S
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import disk as D
from pulsegrid.operators import forecast as P
from pulsegrid.operators import report as T
from pulsegrid.operators import risk as K
from pulsegrid.operators import windows as W
from pulsegrid.plans import inputs as I
from pulsegrid.plans import jobs
from pulsegrid.plans.registry import query
from pulsegrid.schema import DEFAULT_RISK

r6 = I.r6
KEYS = list(schema.SERIES_KEYS)


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def _risk(spark, sf):
    return jobs.ensemble_job(I.app_points(spark, sf))


def _one_score(spark, sf, method: str):
    return _rounded(_risk(spark, sf).risk.select(*KEYS, "hour", F.col(method).alias("score")), "score")


def _score_sql(column: str) -> str:
    return f"SELECT host, metric, CAST(hour AS INTEGER) AS hour, round({column}, 6) AS score FROM slot_scores"


@query("score_zscore", _score_sql("zscore"))
def score_zscore(spark, sf):
    return _one_score(spark, sf, "zscore")


@query("score_iqr", _score_sql("iqr"))
def score_iqr(spark, sf):
    return _one_score(spark, sf, "iqr")


@query("score_moving_average", _score_sql("ma"))
def score_moving_average(spark, sf):
    return _one_score(spark, sf, "ma")


@query("score_ewma", _score_sql("ewma_s"))
def score_ewma(spark, sf):
    return _one_score(spark, sf, "ewma")


@query("score_hour_pattern", """
    SELECT s.host, s.metric, s.ts, round(CASE WHEN h.hour_n < 3 OR h.hour_std = 0 THEN 0
      ELSE least(abs(s.value - h.hour_mean) / h.hour_std / 5, 1) END, 6) AS score
    FROM series s JOIN hours h ON h.host = s.host AND h.metric = s.metric AND h.hour = hour(s.ts)""")
def score_hour_pattern(spark, sf):
    scored = K.score_points(I.series(spark, sf))
    return _rounded(scored.select(*KEYS, "ts", F.col("pattern").alias("score")), "score")


@query("hour_risk", """
    SELECT host, metric, CAST(hour AS INTEGER) AS hour, round(cur, 6) AS expected, round(zscore, 6) AS zscore, round(iqr, 6) AS iqr,
      round(ma, 6) AS ma, round(ewma_s, 6) AS ewma, CAST(0 AS DOUBLE) AS pattern, round(ens, 6) AS ensemble, trend,
      round(slope, 6) AS slope, round(r2, 6) AS r2, round(risk, 6) AS risk,
      CASE WHEN risk > 0.7 THEN 'critical' WHEN risk > 0.5 THEN 'warning' ELSE 'normal' END AS level FROM risk_table""")
def hour_risk(spark, sf):
    return _rounded(
        _risk(spark, sf).risk, "expected", *schema.METHODS, "ensemble", "slope", "r2", "risk"
    )


@query("overall_risk", """
    SELECT host, CAST(hour AS INTEGER) AS hour, round(overall_risk, 6) AS overall_risk, overall_level FROM overall_table""")
def overall_risk(spark, sf):
    return _rounded(_risk(spark, sf).overall, "overall_risk")


@query("hour_risk_last_week", """
    WITH ranged AS (SELECT host, field AS metric, date_trunc('hour', ts) AS ts, avg(value) AS value FROM app_points
      WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-30' GROUP BY ALL),
    b AS (SELECT host, metric, avg(value) AS mean FROM ranged GROUP BY ALL),
    h AS (SELECT host, metric, hour(ts) AS hour, avg(value) AS m FROM ranged GROUP BY ALL)
    SELECT b.host, b.metric, CAST(s.hour AS INTEGER) AS hour, round(coalesce(h.m, b.mean), 6) AS expected
    FROM b CROSS JOIN (SELECT unnest(range(24)) AS hour) s
    LEFT JOIN h ON h.host = b.host AND h.metric = b.metric AND h.hour = s.hour""")
def hour_risk_last_week(spark, sf):
    tables = jobs.ensemble_job(I.app_points(spark, sf), I.NOW, 7)
    return _rounded(tables.risk.select(*KEYS, "hour", "expected"), "expected")


_POINT_SCORES = """
    WITH o AS ({observed}),
    j AS (SELECT o.*, b.n, b.mean, b.std, b.q1, b.q3, b.ma_mean, b.ma_std, b.ewma, b.ewma_std, h.hour_n, h.hour_mean, h.hour_std
      FROM o JOIN baseline b ON b.host = o.host AND b.metric = o.metric
      LEFT JOIN hours h ON h.host = o.host AND h.metric = o.metric AND h.hour = hour(o.ts)),
    s AS (SELECT *, CASE WHEN n < 3 OR std = 0 THEN 0 ELSE least(abs(value - mean) / std / 5, 1) END AS s1,
      CASE WHEN n < 4 OR q3 = q1 THEN 0 ELSE least(greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0) / (q3 - q1) / 1.5, 1) END AS s2,
      CASE WHEN n < 7 OR ma_std = 0 THEN 0 ELSE least(abs(value - ma_mean) / ma_std / 4, 1) END AS s3,
      CASE WHEN n < 3 OR ewma_std = 0 THEN 0 ELSE least(abs(value - ewma) / ewma_std / 3, 1) END AS s4,
      CASE WHEN coalesce(hour_n, 0) < 3 OR hour_std = 0 THEN 0 ELSE least(abs(value - hour_mean) / hour_std / 5, 1) END AS s5 FROM j)
    SELECT host, metric, ts, {id} round(s1, 6) AS zscore, round(s2, 6) AS iqr, round(s3, 6) AS ma, round(s4, 6) AS ewma,
      round(s5, 6) AS pattern, round(0.25::DOUBLE * s1 + 0.2::DOUBLE * s2 + 0.25::DOUBLE * s3 + 0.2::DOUBLE * s4 + 0.1::DOUBLE * s5, 6) AS score FROM s"""


@query("score_points", _POINT_SCORES.format(observed="SELECT host, metric, ts, value FROM series", id=""))
def score_points(spark, sf):
    out = K.score_points(I.series(spark, sf)).select(*KEYS, "ts", *schema.METHODS, "score")
    return _rounded(out, *schema.METHODS, "score")


@query("score_raw_points", _POINT_SCORES.format(
    observed="SELECT event_id, host, field AS metric, ts, value FROM app_points", id="event_id,"))
def score_raw_points(spark, sf):
    out = K.score_points(I.series(spark, sf), observed=I.raw_series(spark, sf))
    return _rounded(out.select(*KEYS, "ts", "event_id", *schema.METHODS, "score"), *schema.METHODS, "score")


_PRIOR = "PARTITION BY host, metric ORDER BY ts ROWS BETWEEN"


@query("score_points_prior", f"""
    WITH f AS (SELECT host, metric, ts, value, count(value) OVER a AS n, avg(value) OVER a AS mean, stddev_pop(value) OVER a AS std,
        avg(value) OVER m AS ma_mean, stddev_pop(value) OVER m AS ma_std, list(value) OVER t AS vals,
        quantile_cont(value, 0.25) OVER t AS q1, quantile_cont(value, 0.75) OVER t AS q3,
        count(value) OVER h AS hn, avg(value) OVER h AS hm, stddev_pop(value) OVER h AS hs FROM series
      WINDOW a AS ({_PRIOR} UNBOUNDED PRECEDING AND 1 PRECEDING), m AS ({_PRIOR} 7 PRECEDING AND 1 PRECEDING),
        t AS ({_PRIOR} UNBOUNDED PRECEDING AND 1 PRECEDING),
        h AS (PARTITION BY host, metric, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    e AS (SELECT *, list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS ew FROM f WHERE n >= 1),
    v AS (SELECT *, sqrt(list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * (x - ew) * (x - ew),
      list_var_pop(vals[1:10]))) AS es FROM e)
    SELECT host, metric, ts, round(CASE WHEN n < 3 OR std = 0 THEN 0 ELSE least(abs(value - mean) / std / 5, 1) END, 6) AS zscore,
      round(CASE WHEN n < 4 OR q3 = q1 THEN 0 ELSE least(greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0) / (q3 - q1) / 1.5, 1) END, 6) AS iqr,
      round(CASE WHEN n < 7 OR ma_std = 0 THEN 0 ELSE least(abs(value - ma_mean) / ma_std / 4, 1) END, 6) AS ma,
      round(CASE WHEN n < 3 OR es = 0 THEN 0 ELSE least(abs(value - ew) / es / 3, 1) END, 6) AS ewma,
      round(CASE WHEN hn < 3 OR hs = 0 THEN 0 ELSE least(abs(value - hm) / hs / 5, 1) END, 6) AS pattern FROM v
    UNION ALL SELECT host, metric, min(ts), 0, 0, 0, 0, 0 FROM series GROUP BY host, metric""")
def score_points_prior(spark, sf):
    out = K.score_points(I.series(spark, sf), history="prior").select(*KEYS, "ts", *schema.METHODS)
    return _rounded(out, *schema.METHODS)


@query("custom_weight_ensemble", """
    SELECT host, metric, CAST(hour AS INTEGER) AS hour, round(0.5 * zscore + 0.5 * iqr + 0.2 * ma, 6) AS score FROM slot_scores""")
def custom_weight_ensemble(spark, sf):
    from dataclasses import replace

    params = replace(DEFAULT_RISK, weights={"zscore": 0.5, "iqr": 0.5})
    methods = {m: F.col(m) for m in ("zscore", "iqr", "ma")}
    out = _risk(spark, sf).risk.withColumn("score", S.ensemble_score(methods, params))
    return _rounded(out.select(*KEYS, "hour", "score"), "score")


@query("peak_risk", """
    SELECT host, metric, CAST(hour AS INTEGER) AS hour, round(profile, 6) AS expected, round(hist_max, 6) AS hist_max,
      round(hist_min, 6) AS hist_min, CAST(days AS INTEGER) AS days, round(f_max, 6) AS f_max, round(f_min, 6) AS f_min,
      round(f_hour, 6) AS f_hour, round(risk, 6) AS risk,
      CASE WHEN risk > 0.7 THEN 'critical' WHEN risk > 0.5 THEN 'warning' ELSE 'normal' END AS level FROM peak_table""")
def peak_risk(spark, sf):
    risk = jobs.peak_job(I.app_points(spark, sf)).risk
    return _rounded(risk, "expected", "hist_max", "hist_min", "f_max", "f_min", "f_hour", "risk")


@query("peak_overall", """
    SELECT host, CAST(hour AS INTEGER) AS hour, round(overall_risk, 6) AS overall_risk,
      CASE WHEN overall_risk > 0.25 THEN 'critical' WHEN overall_risk > 0.2 THEN 'warning' ELSE 'normal' END AS overall_level
    FROM peak_overall""")
def peak_overall(spark, sf):
    tables = jobs.peak_job(I.app_points(spark, sf))
    return _rounded(jobs.peak_levels(tables, 0.2, 0.25), "overall_risk")


@query("risk_summary", """
    SELECT host, count(*) AS total_hours, count(*) FILTER (overall_risk > 0.25) AS critical_hours,
      count(*) FILTER (overall_risk > 0.2 AND overall_risk <= 0.25) AS warning_hours FROM overall_table GROUP BY host""")
def risk_summary(spark, sf):
    return A.risk_summary(jobs.peak_levels(_risk(spark, sf), 0.2, 0.25), ["host"])


@query("metric_risk", """
    SELECT host, metric, round(avg(risk), 6) AS avg_risk, round(max(risk), 6) AS max_risk FROM risk_table GROUP BY ALL""")
def metric_risk(spark, sf):
    return _rounded(A.metric_risk(_risk(spark, sf).risk), "avg_risk", "max_risk")


@query("high_risk_hours", """
    SELECT host, CAST(hour AS INTEGER) AS hour, round(overall_risk, 6) AS overall_risk FROM overall_table WHERE overall_risk >= 0.15""")
def high_risk_hours(spark, sf):
    out = A.high_risk(_risk(spark, sf).overall, 0.15).select("host", "hour", "overall_risk").orderBy("host", "hour")
    return _rounded(out, "overall_risk")


@query("top_contributors", """
    SELECT host, CAST(hour AS INTEGER) AS hour, metric, round(risk, 6) AS risk FROM (
      SELECT *, row_number() OVER (PARTITION BY host, hour ORDER BY risk DESC, metric) AS rn FROM risk_table) r
    WHERE rn <= 2 AND risk > 0.1""")
def top_contributors(spark, sf):
    out = W.top_contributors(_risk(spark, sf).risk, 2, 0.1).select("host", "hour", "metric", "risk")
    return _rounded(out, "risk")


@query("report_rows", """
    WITH o AS (SELECT host, hour, overall_risk AS r,
      CASE WHEN overall_risk > 0.3 THEN 'critical' WHEN overall_risk > 0.15 THEN 'warning' ELSE 'normal' END AS l FROM overall_table),
    s AS (SELECT host, count(*) AS t, count(*) FILTER (l = 'critical') AS c, count(*) FILTER (l = 'warning') AS w FROM o GROUP BY host)
    SELECT host, 'summary' AS section, 0 AS ord, 'total_hours' AS key, CAST(t AS DOUBLE) AS value FROM s
    UNION ALL SELECT host, 'summary', 1, 'critical_hours', c FROM s
    UNION ALL SELECT host, 'summary', 2, 'warning_hours', w FROM s
    UNION ALL SELECT host, 'high_risk_hour', hour, lpad(CAST(hour AS VARCHAR), 2, '0') || ' ' || l, round(r, 6) FROM o WHERE r >= 0.15
    UNION ALL SELECT x.host, 'contributor', x.hour, lpad(CAST(x.hour AS VARCHAR), 2, '0') || ' ' || metric, round(risk, 6) FROM (
      SELECT *, row_number() OVER (PARTITION BY host, hour ORDER BY risk DESC, metric) AS rn FROM risk_table) x
      JOIN o ON o.host = x.host AND o.hour = x.hour AND o.r >= 0.15 WHERE rn <= 2 AND risk > 0.3
    UNION ALL SELECT host, 'metric_average', row_number() OVER (PARTITION BY host ORDER BY metric) - 1, metric, round(avg(risk), 6)
      FROM risk_table GROUP BY host, metric
    UNION ALL SELECT host, 'method_average', row_number() OVER (PARTITION BY host ORDER BY method) - 1, method, round(avg(score), 6) FROM (
      UNPIVOT (SELECT host, zscore, iqr, ma, ewma_s AS ewma, 0::DOUBLE AS pattern FROM risk_table)
        ON zscore, iqr, ma, ewma, pattern INTO NAME method VALUE score) u GROUP BY host, method
    UNION ALL SELECT host, 'recommendation', 0, CASE WHEN c > 0 THEN 'act_on_critical_hours' WHEN w > 0 THEN 'watch_warning_hours'
      ELSE 'keep_monitoring' END, NULL FROM s""".replace("0 AS ord", "CAST(0 AS BIGINT) AS ord"))
def report_rows(spark, sf):
    from dataclasses import replace

    tables = _risk(spark, sf)
    params = replace(DEFAULT_RISK, warning=0.15, critical=0.3)
    out = T.report_rows(tables.risk, jobs.peak_levels(tables, 0.15, 0.3), params)
    return _rounded(out.withColumn("ord", F.col("ord").cast("bigint")), "value")


@query("disk_scores", """
    SELECT device, ts, round(failure_probability, 9) AS failure_probability,
      CASE WHEN failure_probability > 0.8 THEN 'critical' WHEN failure_probability > 0.5 THEN 'warning' ELSE 'healthy' END AS health_status
    FROM disk_scored""")
def disk_scores(spark, sf):
    out = D.score_disks(I.smart(spark, sf)).select("device", "ts", "failure_probability", "health_status")
    return out.withColumn("failure_probability", F.round("failure_probability", 9))


@query("disk_summary", """
    SELECT device, round(max(failure_probability), 9) AS max_probability, bool_or(failure_probability > 0.8) AS above_threshold
    FROM disk_scored GROUP BY device""")
def disk_summary(spark, sf):
    scored = D.score_disks(I.smart(spark, sf)).withColumnRenamed("failure_probability", "probability")
    return A.disk_summary(scored, ["device"]).withColumn("max_probability", F.round("max_probability", 9))


@query("latest_disk_readings", """
    SELECT device, max(ts) AS ts, arg_max(reallocated_sector_ct, ts) AS reallocated_sector_ct,
      arg_max(power_on_hours, ts) AS power_on_hours FROM smart
    WHERE ts >= TIMESTAMP '2001-06-01' - INTERVAL 100 DAY AND ts < TIMESTAMP '2001-06-01' GROUP BY device""")
def latest_disk_readings(spark, sf):
    rows = jobs.latest_smart(I.smart(spark, sf), "2001-06-01 00:00:00", "100 days")
    return rows.select("device", "ts", "reallocated_sector_ct", "power_on_hours")


# ---- forecasts -----------------------------------------------------------------------------
_SEED_SQL = """
    SELECT host, max(ts) AS ts, arg_max(value, ts) AS prediction, avg(value) AS mean FROM (
      SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC) AS rn FROM series WHERE metric = 'cpu_usage') s
    WHERE rn <= 60 GROUP BY host"""


def _seeds(spark, sf):
    """Last hourly value as the prediction, mean of the last 60."""
    recent = W.tail_n(I.series(spark, sf).where("metric = 'cpu_usage'"), 60)
    return recent.groupBy("host").agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("prediction"), F.avg("value").alias("mean"),
        F.max_by("value", "ts").alias("current"),
    )


@query("forecast_decay", f"""
    SELECT host, CAST(step AS INTEGER) AS step, ts + to_minutes(step + 1) AS forecast_ts, round(prediction * 0.95 ** step, 6) AS forecast
    FROM ({_SEED_SQL}) s, (SELECT unnest(range(1440)) AS step) k""")
def forecast_decay(spark, sf):
    out = jobs.forecast_cpu(_seeds(spark, sf), 1440, version=1)
    return _rounded(out.select("host", "step", "forecast_ts", "forecast"), "forecast")


@query("forecast_mean_reverting", f"""
    SELECT host, CAST(step AS INTEGER) AS step, ts + to_minutes(step + 1) AS forecast_ts,
      round(greatest(0, least(100, mean + (prediction - mean) * 0.98 ** step)), 6) AS forecast,
      round(0.85 - 120 / 1440 * 0.3, 6) AS confidence
    FROM ({_SEED_SQL}) s, (SELECT unnest(range(60)) AS step) k""")
def forecast_mean_reverting(spark, sf):
    out = jobs.forecast_cpu(_seeds(spark, sf), 120, version=2)
    return _rounded(out.select("host", "step", "forecast_ts", "forecast", "confidence"), "forecast", "confidence")
