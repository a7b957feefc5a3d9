"""Windowed aggregates, statistics, windows over rows, error measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import drift as M
from pulsegrid.operators import ordered
from pulsegrid.operators import reshape as R
from pulsegrid.operators import scaling
from pulsegrid.operators import windows as W
from pulsegrid.operators.forecast import forecast_vs_actual
from pulsegrid.operators.significance import with_p_value
from pulsegrid.plans import inputs as I
from pulsegrid.plans.registry import query
from pulsegrid.schema import DEFAULT_RISK
from pulsegrid.streaming.feeds import sliding_stats

r6 = I.r6
KEYS = list(schema.SERIES_KEYS)
RAW_ORDER = ["ts", "event_id"]


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def _window_sql(fn: str, minutes: int, stop: bool = False) -> str:
    us = minutes * 60_000_000
    end = f" + {us}" if stop else ""
    return f"""SELECT host, measurement, field, make_timestamp((epoch_us(ts) // {us}) * {us}{end}) AS ts,
      {fn} AS value FROM points GROUP BY ALL"""


@query("window_mean_5m", _window_sql("round(avg(value), 6)", 5))
def window_mean_5m(spark, sf):
    return _rounded(A.aggregate_window(I.points(spark, sf), list(schema.POINT_KEYS), "5m", "mean"), "value")


@query("window_max_1h", _window_sql("max(value)", 60))
def window_max_1h(spark, sf):
    return A.aggregate_window(I.points(spark, sf), list(schema.POINT_KEYS), "1h", "max")


@query("window_min_30s", """
    SELECT host, field, make_timestamp((epoch_us(ts) // 30000000) * 30000000) AS ts, min(value) AS value FROM points GROUP BY ALL""")
def window_min_30s(spark, sf):
    return A.aggregate_window(I.points(spark, sf), ["host", "field"], "30s", "min")


@query("window_sum_2h_stop", _window_sql("round(sum(value), 6)", 120, stop=True))
def window_sum_2h_stop(spark, sf):
    out = A.aggregate_window(I.points(spark, sf), list(schema.POINT_KEYS), "2h", "sum", label="stop")
    return _rounded(out, "value")


@query("window_count_10m", _window_sql("count(value)", 10))
def window_count_10m(spark, sf):
    return A.aggregate_window(I.points(spark, sf), list(schema.POINT_KEYS), "10m", "count")


@query("basic_stats_60s", """
    SELECT host, measurement, field, date_trunc('minute', ts) AS ts, round(avg(value), 6) AS mean, min(value) AS min,
      max(value) AS max, round(stddev_samp(value), 6) AS stdev, count(value) AS n
    FROM points WHERE measurement IN ('cpu', 'mem', 'disk', 'diskio') GROUP BY ALL""")
def basic_stats_60s(spark, sf):
    rows = I.points(spark, sf).where(F.col("measurement").isin(schema.BASIC_STATS_MEASUREMENTS))
    return _rounded(A.basic_stats(rows, list(schema.POINT_KEYS)), "mean", "stdev")


@query("resampled_minutes", """
    WITH w AS (SELECT host, date_trunc('minute', ts) AS ts, avg(value) AS value FROM points
      WHERE measurement = 'cpu' GROUP BY ALL)
    SELECT g.host, g.ts, round(w.value, 6) AS value FROM (
      SELECT host, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM w GROUP BY host) g
    LEFT JOIN w USING (host, ts)""")
def resampled_minutes(spark, sf):
    cpu = I.points(spark, sf).where("measurement = 'cpu'").select("host", "ts", "value")
    return _rounded(A.resample_mean(cpu, ["host"]), "value")


@query("daily_peaks", """
    SELECT host, metric, CAST(ts AS DATE) AS day, round(max(value), 6) AS day_max, round(min(value), 6) AS day_min
    FROM series GROUP BY ALL""")
def daily_peaks(spark, sf):
    return _rounded(A.daily_peaks(I.series(spark, sf)), "day_max", "day_min")


@query("day_spans", """
    SELECT host, metric, CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS INTEGER) AS span_days,
      count(DISTINCT CAST(ts AS DATE)) AS observed_days FROM series GROUP BY ALL""")
def day_spans(spark, sf):
    return A.day_span(I.series(spark, sf))


@query("peak_baseline", """
    SELECT host, metric, round(hist_max, 6) AS hist_max, round(hist_min, 6) AS hist_min, CAST(days AS INTEGER) AS days FROM peaks""")
def peak_baseline(spark, sf):
    return _rounded(A.peak_baseline(A.daily_peaks(I.series(spark, sf))), "hist_max", "hist_min")


@query("hourly_stats", """
    SELECT host, metric, CAST(hour AS INTEGER) AS hour, hour_n, round(hour_mean, 6) AS hour_mean,
      round(hour_std, 6) AS hour_std FROM hours""")
def hourly_stats(spark, sf):
    return _rounded(A.hourly_stats(I.series(spark, sf)), "hour_mean", "hour_std")


@query("series_stats", """
    SELECT host, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
      round(var_pop(value), 6) AS var FROM series GROUP BY ALL""")
def series_stats(spark, sf):
    return _rounded(A.series_stats(I.series(spark, sf)), "mean", "std", "var")


def _iqr_sql(source: str, key: str) -> str:
    return f"""
    SELECT host, metric, n, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
      round(q1 - 1.5 * (q3 - q1), 6) AS low_fence, round(q3 + 1.5 * (q3 - q1), 6) AS high_fence FROM (
      SELECT host, {key} AS metric, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM {source} GROUP BY ALL) q"""


@query("iqr_hourly", _iqr_sql("series", "metric"))
def iqr_hourly(spark, sf):
    return _rounded(A.iqr_bounds(I.series(spark, sf)), "q1", "q3", "iqr", "low_fence", "high_fence")


@query("iqr_raw_points", _iqr_sql("app_points", "field"))
def iqr_raw_points(spark, sf):
    out = A.iqr_bounds(I.raw_series(spark, sf), bounded=False)
    return _rounded(out, "q1", "q3", "iqr", "low_fence", "high_fence")


@query("score_threshold", """
    SELECT host, count(value) AS n, round(quantile_cont(value, 0.01), 6) AS threshold FROM points GROUP BY host""")
def score_threshold(spark, sf):
    out = A.anomaly_threshold(I.points(spark, sf), ["host"], 1.0, "value")
    return _rounded(out, "threshold")


def _trend_sql(source: str, key: str, order: str) -> str:
    return f"""
    WITH t AS (SELECT host, {key} AS metric, value, row_number() OVER (PARTITION BY host, {key} ORDER BY {order}) - 1 AS rn FROM {source}),
    f AS (SELECT host, metric, count(*) AS n, avg(value) AS mean, regr_slope(value, rn) AS slope, regr_r2(value, rn) AS r2,
      var_pop(value) AS v FROM t GROUP BY ALL)
    SELECT host, metric, n, round(mean, 6) AS mean, round(CASE WHEN n >= 10 THEN slope ELSE 0 END, 6) AS slope,
      round(CASE WHEN n >= 10 AND v <> 0 THEN r2 ELSE 0 END, 6) AS r2,
      CASE WHEN n < 10 OR abs(slope) < 0.01 * mean THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS trend
    FROM f"""


@query("trend_hourly", _trend_sql("series", "metric", "ts"))
def trend_hourly(spark, sf):
    return _rounded(A.trend(I.series(spark, sf)), "mean", "slope", "r2")


@query("trend_raw_points", _trend_sql("app_points", "field", "ts, event_id"))
def trend_raw_points(spark, sf):
    return _rounded(A.trend(I.raw_series(spark, sf), KEYS, RAW_ORDER, bounded=False), "mean", "slope", "r2")


# Two-sided tail of Student's t as a ratio of integrals of cos^(dof - 1), by Simpson's rule.
_P_VALUE_SQL = f"""
    WITH steps AS (SELECT unnest(range(4001)) AS i),
    weights AS (SELECT i, CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM steps),
    line AS (SELECT host, metric, count(*) AS n, CASE WHEN count(*) >= 10 AND var_pop(value) <> 0 THEN regr_r2(value, rn) ELSE 0 END AS r2
      FROM (SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts) - 1 AS rn FROM series) s GROUP BY ALL),
    angle AS (SELECT host, metric, greatest(n - 3, 0) AS power, asin(sqrt(least(r2, 1))) AS a, pi() / 2 AS b FROM line WHERE n >= 3),
    tail AS (SELECT host, metric, (b - a) * sum(w * pow(greatest(cos(a + (b - a) * i / 4000), 0), power))
      / (b * sum(w * pow(greatest(cos(b * i / 4000), 0), power))) AS p FROM angle CROSS JOIN weights GROUP BY host, metric, a, b)
    SELECT t.*, round(p, 6) AS p_value FROM ({_trend_sql("series", "metric", "ts")}) t LEFT JOIN tail USING (host, metric)"""


@query("trend_p_values", _P_VALUE_SQL)
def trend_p_values(spark, sf):
    return _rounded(with_p_value(A.trend(I.series(spark, sf))), "mean", "slope", "r2", "p_value")


@query("anomaly_summary", """
    SELECT host, count(*) FILTER (value < 5) AS anomaly_count, count(*) AS total_points,
      round(count(*) FILTER (value < 5) / count(*), 6) AS anomaly_rate,
      round(count(*) FILTER (value < 5) / count(*) * 100, 6) AS anomaly_pct, round(avg(value), 6) AS mean_score,
      count(*) FILTER (value < 5) > 0 AS is_anomalous FROM points GROUP BY host""")
def anomaly_summary(spark, sf):
    scored = I.points(spark, sf).withColumns({"score": F.col("value"), "is_anomaly": F.col("value") < 5})
    return _rounded(A.anomaly_summary(scored, ["host"]), "anomaly_rate", "anomaly_pct", "mean_score")


@query("anomaly_details", """
    SELECT host, event_id, ts, value FROM (
      SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM points WHERE value < 5) a WHERE rn <= 20""")
def anomaly_details(spark, sf):
    scored = I.points(spark, sf).withColumn("is_anomaly", F.col("value") < 5)
    return W.anomaly_details(scored, ["host"], 20, RAW_ORDER).select("host", "event_id", "ts", "value")


@query("tail_60", """
    SELECT host, metric, ts, round(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts DESC) AS rn FROM series) s WHERE rn <= 60""")
def tail_60(spark, sf):
    return _rounded(W.tail_n(I.series(spark, sf), 60).drop("rank"), "value")


@query("tail_10_raw", """
    SELECT host, metric, event_id, rank FROM (
      SELECT host, field AS metric, event_id, CAST(row_number() OVER (PARTITION BY host, field ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank
      FROM app_points) s WHERE rank <= 10""")
def tail_10_raw(spark, sf):
    out = W.tail_n(I.raw_series(spark, sf), 10, order=RAW_ORDER)
    return out.select("host", "metric", "event_id", "rank")


@query("limit_per_series", """
    SELECT host, field, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY host, field ORDER BY ts, event_id) AS rn FROM points) p WHERE rn <= 25""")
def limit_per_series(spark, sf):
    return W.limit_per_series(I.points(spark, sf), ["host", "field"], 25, RAW_ORDER).select("host", "field", "event_id")


_MA = "OVER (PARTITION BY host, metric ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("moving_stats_hourly", f"""
    SELECT host, metric, ts, round(value, 6) AS value, count(value) {_MA} AS ma_n, round(avg(value) {_MA}, 6) AS ma_mean,
      round(stddev_pop(value) {_MA}, 6) AS ma_std FROM series""")
def moving_stats_hourly(spark, sf):
    return _rounded(W.moving_stats(I.series(spark, sf)), "value", "ma_mean", "ma_std")


_MA_RAW = "OVER (PARTITION BY host, field ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query("moving_stats_raw", f"""
    SELECT host, field AS metric, event_id, count(value) {_MA_RAW} AS ma_n, round(avg(value) {_MA_RAW}, 6) AS ma_mean,
      round(stddev_pop(value) {_MA_RAW}, 6) AS ma_std FROM app_points""")
def moving_stats_raw(spark, sf):
    out = W.moving_stats(I.raw_series(spark, sf), 7, KEYS, RAW_ORDER, bounded=False)
    return _rounded(out, "ma_mean", "ma_std").select("host", "metric", "event_id", "ma_n", "ma_mean", "ma_std")


def _ewma_sql(source: str, key: str, order: str) -> str:
    return f"""
    WITH t AS (SELECT host, {key} AS metric, list(value ORDER BY {order}) AS vals FROM {source} GROUP BY ALL),
    e AS (SELECT *, len(vals) AS n, list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x) AS ewma FROM t),
    v AS (SELECT *, list_reduce(vals, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * (x - ewma) * (x - ewma),
      list_var_pop(vals[1:10])) AS var FROM e)
    SELECT host, metric, n, round(ewma, 6) AS ewma, round(var, 6) AS ewma_var, round(sqrt(var), 6) AS ewma_std FROM v"""


@query("ewma_hourly", _ewma_sql("series", "metric", "ts"))
def ewma_hourly(spark, sf):
    return _rounded(W.ewma_stats(I.series(spark, sf)), "ewma", "ewma_var", "ewma_std")


@query("ewma_raw_points", _ewma_sql("app_points", "field", "ts, event_id"))
def ewma_raw_points(spark, sf):
    out = W.ewma_stats(I.raw_series(spark, sf), order=RAW_ORDER, bounded=False)
    return _rounded(out, "ewma", "ewma_var", "ewma_std")


_SEQ = "OVER (PARTITION BY host, {k} ORDER BY {o} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


def _seq_sql(source: str, key: str, order: str) -> str:
    over = _SEQ.format(k=key, o=order)
    return f"""
    SELECT host, metric, ts, size, round(first, 6) AS first, round(last, 6) AS last, round(target, 6) AS target FROM (
      SELECT host, {key} AS metric, ts, value AS target, count(*) {over} AS size, first_value(value) {over} AS first,
        last_value(value) {over} AS last, count(*) OVER (PARTITION BY host, {key}) AS c FROM {source}) s
    WHERE size = 12 AND c >= 24"""


def _seq_out(df):
    window = F.flatten("window")
    return df.select(
        "host", "metric", "ts", F.size(window).cast("bigint").alias("size"), r6(window[0]).alias("first"),
        r6(F.element_at(window, -1)).alias("last"), r6("target").alias("target"),
    )


@query("sequence_windows", _seq_sql("series", "metric", "ts"))
def sequence_windows(spark, sf):
    return _seq_out(W.sequence_windows(I.series(spark, sf), KEYS, ["value"], 12))


@query("sequence_windows_raw", _seq_sql("app_points", "field", "ts, event_id"))
def sequence_windows_raw(spark, sf):
    return _seq_out(W.sequence_windows(I.raw_series(spark, sf), KEYS, ["value"], 12, RAW_ORDER, bounded=False))


@query("chrono_split", """
    SELECT host, metric, part, count(*) AS points, min(ts) AS first_ts, max(ts) AS last_ts FROM (
      SELECT host, metric, ts, CASE WHEN rn < floor(floor(n * 0.8) * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) THEN 'val' ELSE 'test' END AS part
      FROM (SELECT host, field AS metric, ts, row_number() OVER (PARTITION BY host, field ORDER BY ts, event_id) - 1 AS rn,
        count(*) OVER (PARTITION BY host, field) AS n FROM app_points) a) b GROUP BY ALL""")
def chrono_split(spark, sf):
    split = W.chrono_split(I.raw_series(spark, sf), KEYS, RAW_ORDER, bounded=False)
    return split.groupBy(*KEYS, "part").agg(
        F.count(F.lit(1)).alias("points"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query("hour_rank", """
    SELECT host, metric, CAST(hour AS INTEGER) AS hour, CAST(hour_rank AS INTEGER) AS hour_rank FROM peak_slots""")
def hour_rank(spark, sf):
    return W.hour_rank(A.hourly_profile(I.series(spark, sf))).select(*KEYS, "hour", "hour_rank")


@query("rate_of_change", """
    SELECT host, metric, event_id, round(value - p, 6) AS change, round((value - p) / nullif(dt, 0), 6) AS per_second,
      round((value - p) / nullif(p, 0), 6) AS relative FROM (
      SELECT host, field AS metric, event_id, value, lag(value) OVER w AS p, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt
      FROM app_points WINDOW w AS (PARTITION BY host, field ORDER BY ts, event_id)) a""")
def rate_of_change(spark, sf):
    out = W.rate_of_change(I.raw_series(spark, sf), KEYS, RAW_ORDER, bounded=False)
    return _rounded(out, "change", "per_second", "relative").select(*KEYS, "event_id", "change", "per_second", "relative")


@query("series_positions", """
    SELECT host, metric, event_id, rn, n FROM (SELECT host, field AS metric, event_id,
      row_number() OVER (PARTITION BY host, field ORDER BY ts, event_id) - 1 AS rn,
      count(*) OVER (PARTITION BY host, field) AS n FROM app_points) a""")
def series_positions(spark, sf):
    out = ordered.series_index(I.raw_series(spark, sf), KEYS, RAW_ORDER, total="n")
    return out.select(*KEYS, "event_id", "rn", "n")


@query("sliding_hour_stats", """
    WITH k AS (SELECT unnest(range(6)) AS k)
    SELECT host, ts, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (
      SELECT host, make_timestamp((epoch_us(p.ts) // 600000000 - k) * 600000000) AS ts, value FROM points p, k) s GROUP BY ALL""")
def sliding_hour_stats(spark, sf):
    out = sliding_stats(I.points(spark, sf), ["host"], "60 minutes", "10 minutes", late=None)
    return _rounded(out, "mean", "std")


@query("sliding_large_values", """
    WITH k AS (SELECT unnest(range(6)) AS k)
    SELECT host, ts, count(*) AS n, round(avg(value), 3) AS mean, round(stddev_pop(value), 3) AS std FROM (
      SELECT host, make_timestamp((epoch_us(p.ts) // 600000000 - k) * 600000000) AS ts, floor(value) + 1e9::DOUBLE AS value
      FROM points p, k) s GROUP BY ALL""")
def sliding_large_values(spark, sf):
    rows = I.points(spark, sf).withColumn("value", F.floor("value") + F.lit(1e9))
    out = sliding_stats(rows, ["host"], "60 minutes", "10 minutes", late=None)
    return out.withColumns({c: F.round(c, 3) for c in ("mean", "std")})


@query("sliding_60_samples", """
    SELECT host, metric, ts, count(value) OVER w AS ma_n, round(avg(value) OVER w, 6) AS ma_mean,
      round(stddev_pop(value) OVER w, 6) AS ma_std FROM series
    WINDOW w AS (PARTITION BY host, metric ORDER BY ts ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
def sliding_60_samples(spark, sf):
    out = W.moving_stats(I.series(spark, sf), 60, include_current=True)
    return _rounded(out.drop("value"), "ma_mean", "ma_std")


# ---- errors, scaling, drift ----------------------------------------------------------------
def _naive(spark, sf):
    spec = Window.partitionBy(*KEYS).orderBy("ts")
    return I.series(spark, sf).withColumn("forecast", F.lag("value").over(spec))


_NAIVE_SQL = "SELECT host, metric, ts, value, lag(value) OVER (PARTITION BY host, metric ORDER BY ts) AS f FROM series"


@query("regression_metrics", f"""
    SELECT host, metric, count(*) AS n, round(avg(abs(value - f)), 6) AS mae, round(avg((value - f) ** 2), 6) AS mse,
      round(sqrt(avg((value - f) ** 2)), 6) AS rmse, round(avg(abs((value - f) / nullif(value, 0))), 6) AS mape,
      round(1 - sum((value - f) ** 2) / nullif(var_pop(value) * count(*), 0), 6) AS r2
    FROM ({_NAIVE_SQL}) s WHERE f IS NOT NULL GROUP BY ALL""")
def regression_metrics(spark, sf):
    out = A.regression_metrics(_naive(spark, sf), KEYS, "value", "forecast")
    return _rounded(out, "mae", "mse", "rmse", "mape", "r2")


@query("forecast_errors", f"""
    SELECT host, metric, ts, round(f, 6) AS forecast, round(value, 6) AS actual, round(value - f, 6) AS error,
      round(abs(value - f), 6) AS abs_error, round(abs((value - f) / nullif(value, 0)) * 100, 6) AS pct_error
    FROM ({_NAIVE_SQL}) s WHERE f IS NOT NULL""")
def forecast_errors(spark, sf):
    forecast = _naive(spark, sf).where(F.col("forecast").isNotNull()).select(*KEYS, "ts", "forecast")
    out = forecast_vs_actual(forecast, I.series(spark, sf), KEYS)
    return _rounded(out, "forecast", "actual", "error", "abs_error", "pct_error")


def _judged(spark, sf):
    """Disk scores with the label, and the score's call at 0.5."""
    from pulsegrid.operators.disk import score_disks

    scored = score_disks(I.smart(spark, sf))
    return scored.withColumn("called", (F.col("failure_probability") > 0.5).cast("int"))


@query("classification_report", """
    WITH c AS (SELECT failed, CASE WHEN failure_probability > 0.5 THEN 1 ELSE 0 END AS called FROM disk_scored),
    k AS (SELECT unnest([0, 1]) AS class),
    s AS (SELECT class, count(*) FILTER (failed = class AND called = class) AS tp, count(*) FILTER (failed = class) AS support,
      count(*) FILTER (called = class) AS predicted FROM c, k GROUP BY class)
    SELECT class, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall,
      round(2 * tp / (predicted + support), 6) AS f1, support FROM s""")
def classification_report(spark, sf):
    return _rounded(A.confusion(_judged(spark, sf), "failed", "called"), "precision", "recall", "f1")


@query("roc_auc", """
    WITH d AS (SELECT failed, round(failure_probability, 9) AS p FROM disk_scored),
    r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rk FROM d)
    SELECT count(*) FILTER (failed = 1) AS positives, count(*) FILTER (failed = 0) AS negatives,
      round((sum(rk) FILTER (failed = 1) - count(*) FILTER (failed = 1) * (count(*) FILTER (failed = 1) + 1) / 2)
        / (count(*) FILTER (failed = 1) * count(*) FILTER (failed = 0)), 6) AS auc FROM r""")
def roc_auc(spark, sf):
    rows = _judged(spark, sf).withColumns(
        {"score": F.round("failure_probability", 9), "label": F.col("failed"), "all": F.lit(1)}
    )
    return _rounded(A.roc_auc(rows, ["all"]).drop("all"), "auc")


@query("scaled_features", """
    WITH s AS (SELECT avg(temperature_celsius) AS tm, stddev_pop(temperature_celsius) AS ts_, avg(power_on_hours) AS pm,
      stddev_pop(power_on_hours) AS ps FROM smart)
    SELECT device, ts, round((temperature_celsius - tm) / ts_, 6) AS temperature_celsius,
      round((power_on_hours - pm) / ps, 6) AS power_on_hours FROM smart, s""")
def scaled_features(spark, sf):
    names = ["temperature_celsius", "power_on_hours"]
    rows = I.smart(spark, sf)
    out = scaling.fit_scaler(rows, names).scale(rows)
    return _rounded(out.select("device", "ts", *names), *names)


@query("drift", """
    WITH b AS (SELECT host, field AS metric, (row_number() OVER (PARTITION BY host, field ORDER BY ts, event_id) - 1) // 100 AS bucket,
        value FROM app_points),
    s AS (SELECT host, metric, bucket, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM b GROUP BY ALL),
    j AS (SELECT s.*, abs(s.mean - f.mean) / abs(f.mean) AS dm, abs(s.std - f.std) / abs(nullif(f.std, 0)) AS ds
      FROM s JOIN s f ON f.host = s.host AND f.metric = s.metric AND f.bucket = 0)
    SELECT host, metric, CAST(bucket AS BIGINT) AS bucket, n, round(mean, 6) AS mean, round(std, 6) AS std, round(dm, 6) AS mean_shift,
      round(ds, 6) AS std_shift, coalesce(greatest(dm, ds) > 0.1, false) AS retrain FROM j""")
def drift(spark, sf):
    out = M.drift(I.raw_series(spark, sf), KEYS, RAW_ORDER, window=100)
    return _rounded(out, "mean", "std", "mean_shift", "std_shift")


@query("distribution_shift", """
    WITH b AS (SELECT host, field AS metric, (row_number() OVER (PARTITION BY host, field ORDER BY ts, event_id) - 1) // 100 AS bucket,
        value FROM app_points),
    s AS (SELECT host, metric, bucket, count(value) AS n FROM b GROUP BY ALL),
    p AS (SELECT s.*, f.n AS m FROM s JOIN s f ON f.host = s.host AND f.metric = s.metric AND f.bucket = 0),
    u AS (SELECT p.*, b.value, p.m AS step FROM p JOIN b USING (host, metric, bucket)
      UNION ALL SELECT p.*, b.value, -p.n FROM p JOIN b ON b.host = p.host AND b.metric = p.metric AND b.bucket = 0),
    v AS (SELECT host, metric, bucket, n, m, value, sum(step) AS step FROM u WHERE value IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, abs(sum(step) OVER w) AS run, coalesce(lead(value) OVER w - value, 0) AS gap FROM v
      WINDOW w AS (PARTITION BY host, metric, bucket ORDER BY value)),
    d AS (SELECT host, metric, bucket, n, max(run) / (n * m)::DOUBLE AS ks, sum(run * gap) / (n * m) AS wasserstein,
      sqrt(-ln(0.025::DOUBLE) / 2) * sqrt((n + m)::DOUBLE / (n * m)) AS critical FROM c GROUP BY host, metric, bucket, n, m)
    SELECT host, metric, CAST(bucket AS BIGINT) AS bucket, n, round(ks, 6) AS ks, round(critical, 6) AS critical,
      round(wasserstein, 6) AS wasserstein, ks > greatest(critical, 0.1) AS retrain FROM d""")
def distribution_shift(spark, sf):
    out = M.distribution_shift(I.raw_series(spark, sf), KEYS, RAW_ORDER, window=100)
    return _rounded(out, "ks", "critical", "wasserstein")


@query("performance_drops", f"""
    WITH e AS (SELECT host, metric, ts >= TIMESTAMP '2024-01-15' AS late, abs(value - f) AS err FROM ({_NAIVE_SQL}) n),
    m AS (SELECT host, metric, avg(err) FILTER (NOT late) AS before, avg(err) FILTER (late) AS after FROM e GROUP BY ALL)
    SELECT host, metric, round(before, 6) AS before, round(after, 6) AS after,
      coalesce((after - before) / nullif(abs(before), 0) > 0.05, false) AS dropped FROM m""")
def performance_drops(spark, sf):
    error, late = F.abs(F.col("value") - F.col("forecast")), F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")
    errors = _naive(spark, sf).groupBy(*KEYS).agg(
        F.avg(F.when(~late, error)).alias("before"), F.avg(F.when(late, error)).alias("after")
    )
    judged = errors.withColumn("dropped", M.performance_drop(F.col("before"), F.col("after")))
    return _rounded(judged, "before", "after")


@query("window_per_tag_series", """
    SELECT host, measurement, field, tag_set, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS value FROM tagged_points GROUP BY ALL""")
def window_per_tag_series(spark, sf):
    rows = R.with_tag_set(I.tagged_points(spark, sf))
    return _rounded(A.aggregate_window(rows, [*schema.POINT_KEYS, "tag_set"], "1h"), "value")


@query("last_per_tag_series", """
    SELECT host, measurement, field, tag_set, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM tagged_points GROUP BY ALL""")
def last_per_tag_series(spark, sf):
    rows = R.with_tag_set(I.tagged_points(spark, sf))
    return A.last_per_series(rows, [*schema.POINT_KEYS, "tag_set"], RAW_ORDER, ["ts", "value"])


@query("minimum_rows_guard", """
    SELECT host, metric, n, CASE WHEN n >= 20 THEN round(mean, 6) END AS mean FROM baseline""")
def minimum_rows_guard(spark, sf):
    stats = _rounded(A.series_stats(I.series(spark, sf)), "mean")
    return W.minimum_rows(stats, KEYS, 20, ["mean"]).select(*KEYS, "n", "mean")


@query("exact_quantiles_raw", """
    SELECT host, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
      round(quantile_cont(value, 0.99), 6) AS p99 FROM app_points GROUP BY host""")
def exact_quantiles_raw(spark, sf):
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return _rounded(ordered.exact_quantiles(I.app_points(spark, sf), ["host"], "value", probs), *probs)


# Whole numbers far from zero: quarters of them are exact, so nothing is rounded.
@query("quantiles_far_from_zero", """
    SELECT host, count(value) AS n, quantile_cont(floor(value) + 1e12, 0.25) - 1e12 AS q1, quantile_cont(floor(value) + 1e12, 0.5) - 1e12 AS mid,
      quantile_cont(floor(value) + 1e12, 0.75) - 1e12 AS q3 FROM app_points GROUP BY host""")
def quantiles_far_from_zero(spark, sf):
    far = I.app_points(spark, sf).withColumn("value", F.floor("value") + F.lit(1e12))
    found = ordered.exact_quantiles(far, ["host"], "value", {"q1": 0.25, "mid": 0.5, "q3": 0.75})
    return found.select("host", "n", *[(F.col(q) - 1e12).alias(q) for q in ("q1", "mid", "q3")])


@query("method_weights", f"""
    SELECT host, method, round(avg_score, 6) AS avg_score, weight FROM (
      SELECT host, 'zscore' AS method, avg(zscore) AS avg_score, 0.25::DOUBLE AS weight FROM risk_table GROUP BY host
      UNION ALL SELECT host, 'iqr', avg(iqr), {DEFAULT_RISK.weights['iqr']} FROM risk_table GROUP BY host
      UNION ALL SELECT host, 'ma', avg(ma), {DEFAULT_RISK.weights['ma']} FROM risk_table GROUP BY host
      UNION ALL SELECT host, 'ewma', avg(ewma_s), {DEFAULT_RISK.weights['ewma']} FROM risk_table GROUP BY host
      UNION ALL SELECT host, 'pattern', 0, {DEFAULT_RISK.weights['pattern']} FROM risk_table GROUP BY host) m""")
def method_weights(spark, sf):
    from pulsegrid.plans import jobs

    risk = jobs.ensemble_job(I.app_points(spark, sf)).risk
    return _rounded(A.method_contribution(risk, ["host"], DEFAULT_RISK.weights), "avg_score")
