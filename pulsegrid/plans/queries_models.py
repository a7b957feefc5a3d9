"""Model jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators import disk_model as DM
from pulsegrid.operators import risk as K
from pulsegrid.operators import seasonal as E
from pulsegrid.operators import sequence_model as Q
from pulsegrid.operators import reshape as R
from pulsegrid.operators.iforest import fit_isolation_forest
from pulsegrid.operators.ordered import union_all
from pulsegrid.operators.scaling import fit_scaler
from pulsegrid.operators.windows import chrono_split, hash_split
from pulsegrid.plans import inputs as I
from pulsegrid.plans import jobs
from pulsegrid.plans import training
from pulsegrid.plans.registry import query
from pulsegrid.session import shared_dir
from pulsegrid.sources import sinks
from pulsegrid.streaming import feeds
from pulsegrid.streaming import ordered_rules as O
from pulsegrid.streaming.cycle import cycle_writer
from pulsegrid.streaming.quota import stream_token_bucket

r6 = I.r6
KEYS = list(schema.SERIES_KEYS)
FEATURES = ["cpu_usage_user", "mem_used_percent", "disk_used_percent"]
SMART = schema.SMART_SCORE_ATTRIBUTES
LENGTH = 24


def _hour_grid(spark, sf):
    return jobs.aligned_frame(I.points(spark, sf), FEATURES, "1 hour")


# ---- models ------------------------------------------------------------------------------------
@query("sequence_forecast")
def sequence_forecast(spark, sf):
    grid = _hour_grid(spark, sf)
    scaler = fit_scaler(grid, FEATURES)
    model = Q.fit_sequence_model(Q.training_sequences(grid, scaler, LENGTH, ["host"]).where("part = 'train'"))
    return jobs.forecast_cpu(Q.predict_next(model, scaler, grid, LENGTH, ["host"]))


@query("isolation_forest_summary")
def isolation_forest_summary(spark, sf):
    grid = _hour_grid(spark, sf)
    model = fit_isolation_forest(grid, FEATURES, ["host", "ts"])
    return A.anomaly_summary(model.transform(grid), ["host"])


@query("detected_anomalies")
def detected_anomalies(spark, sf):
    rows = I.points(spark, sf)
    fields = ["usage_user", "usage_system"]
    wide = R.pivot_fields(
        A.aggregate_window(rows.where("measurement = 'cpu'"), ["host", "field"], "1m"), ["host", "ts"], fields
    )
    model = fit_isolation_forest(R.feature_policy(wide, fields), fields, ["host", "ts"])
    return jobs.detect_anomalies(rows, model, "cpu")[1]


@query("disk_model_predictions")
def disk_model_predictions(spark, sf):
    split = hash_split(I.smart(spark, sf), ["device", "ts"])
    model = DM.fit_disk_model(split.where("part = 'train'"), "failed", SMART)
    return DM.predict_disk(model, split.where("part = 'test'"), SMART, policy="reject")


@query("disk_outlook")
def disk_outlook(spark, sf):
    rows = I.smart(spark, sf)
    model = DM.fit_disk_model(rows.where("ts < TIMESTAMP_NTZ '2001-06-01 00:00:00'"), "failed", SMART)
    devices = I.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("device"))
    return jobs.disk_outlook(devices, rows, model, SMART, "2001-06-01 00:00:00", "30 days")


@query("seasonal_forecast")
def seasonal_forecast(spark, sf):
    return E.seasonal_forecast(E.fit_seasonal(I.series(spark, sf), KEYS))


def _host_smart(spark, sf):
    """SMART rows with the host of their device."""
    return I.smart(spark, sf).withColumn("host", F.concat(F.lit("h"), (F.col("device") % 4).cast("string")))


def _train(spark, sf, grid, **more):
    """All four models."""
    return training.run_training(
        grid, FEATURES, LENGTH, smart=_host_smart(spark, sf), smart_features=SMART, seasonal_target=FEATURES[0], **more
    )


@query("training_run")
def training_run(spark, sf):
    _, results, _ = _train(spark, sf, _hour_grid(spark, sf), now=F.lit(I.NOW).cast("timestamp_ntz"))
    return results


def _cycle_rows(points, alerts, forecasts):
    """Prediction points, alerts and forecast points of a cycle as rows of one shape."""
    ahead = sinks.forecasts_to_points(forecasts, FEATURES[0])
    kinds = [("point", points), ("forecast", ahead)]
    made = [p.select(F.lit(k).alias("kind"), "host", "ts", F.concat_ws(".", "measurement", "field").alias("name"), "value") for k, p in kinds]
    raised = alerts.select(F.lit("alert").alias("kind"), "host", "ts", F.col("metric").alias("name"), "value")
    return union_all([*made, raised])


@query("prediction_cycle")
def prediction_cycle(spark, sf):
    """Models of all days but the last, stored and read back; a cycle at the end that takes up the last day."""
    grid = _hour_grid(spark, sf)
    path = shared_dir(spark, "models")
    _train(spark, sf, grid.where("ts < TIMESTAMP_NTZ '2024-01-29 00:00:00'"), save_to=path)
    models = training.load_models(spark, path)
    found = training.run_cycle(grid, models, smart=_host_smart(spark, sf), smart_features=SMART)
    return _cycle_rows(found.points, found.alerts, found.forecasts)


@query("stream_prediction_cycle")
def stream_prediction_cycle(spark, sf):
    """The cycle with all models as the body of a stream over the metric points of the last days; the newest cycle's rows."""
    path = shared_dir(spark, "stream-models")
    _train(spark, sf, _hour_grid(spark, sf).where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), save_to=path)
    events = I.table(spark, sf, "events")
    feed = I.points_of(feeds.stream_points(spark, sf, events.schema, "events.parquet"))
    root = shared_dir(spark, "stream-cycle")
    body = cycle_writer(
        training.load_models(spark, path), FEATURES, f"{root}/points", f"{root}/results", f"{root}/alerts", "60 days", "1 hour",
        smart=_host_smart(spark, sf), smart_features=SMART, forecasts_path=f"{root}/forecasts",
    )
    feeds.stream_cycle(feed, body, f"{root}/log", available_now=True).awaitTermination()
    return _cycle_rows(*(spark.read.parquet(f"{root}/{x}").drop("batch") for x in ("results", "alerts", "forecasts")))


# Per (series, day) the number of rows and sums that the seasonal fit is solved from: trend and first daily wave with the value.
@query("seasonal_day_sums", """
    SELECT host, metric, day, n, round(one_y, 6) AS one_y, round(trend_trend, 6) AS trend_trend, round(trend_y, 6) AS trend_y,
      round(sin_y, 6) AS sin_y, round(sin_cos, 6) AS sin_cos, round(yy, 6) AS yy FROM (
      SELECT host, metric, CAST(ts AS DATE) AS day, count(*) AS n, sum(y) AS one_y, sum(d / 30 * d / 30) AS trend_trend, sum(d / 30 * y) AS trend_y,
        sum(sin(2 * pi() * d) * y) AS sin_y, sum(sin(2 * pi() * d) * cos(2 * pi() * d)) AS sin_cos, sum(y * y) AS yy FROM (
        SELECT host, metric, ts, ln(1 + greatest(value, 0)) AS y, hour(ts) / 24.0::DOUBLE AS d FROM series) t GROUP BY ALL) s""")
def seasonal_day_sums(spark, sf):
    sums = E.cell_sums(I.series(spark, sf), KEYS, True, (E.DAILY, E.WEEKLY, E.YEARLY))
    size = 3 + 2 * sum(h for _, h in (E.DAILY, E.WEEKLY, E.YEARLY))

    def at(i, j):
        return r6(F.element_at("products", i * size - i * (i - 1) // 2 + j - i + 1))

    named = {"one_y": (0, size - 1), "trend_trend": (1, 1), "trend_y": (1, size - 1), "sin_y": (2, size - 1), "sin_cos": (2, 3), "yy": (size - 1, size - 1)}
    day = F.to_date(F.timestamp_micros("base")).alias("day")
    return sums.select(*KEYS, day, "n", *[at(*place).alias(name) for name, place in named.items()])


# The fit of all rows against the fit of the rows before a day, brought up to date with the rest: what is known of a series.
@query("seasonal_update_facts", """
    SELECT host, metric, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, true AS same_fit FROM series GROUP BY ALL""")
def seasonal_update_facts(spark, sf):
    series = I.series(spark, sf)
    whole = E.fit_seasonal(series, KEYS)
    early = E.fit_seasonal(series.where("ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"), KEYS)
    late = E.update_seasonal(early, series)
    other = late.table.select(*KEYS, F.col("coef").alias("_coef"), F.col("n").alias("_n"), F.col("last_ts").alias("_last"))
    apart = F.aggregate(F.zip_with("coef", "_coef", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: F.greatest(a, b))
    same = (apart < 1e-6) & (F.col("n") == F.col("_n")) & (F.col("last_ts") == F.col("_last"))
    first = F.timestamp_micros(F.round(F.col("origin") * 1e6).cast("long")).cast("timestamp_ntz")
    return whole.table.join(other, KEYS).select(*KEYS, "n", first.alias("first_ts"), "last_ts", same.alias("same_fit"))


@query("naive_evaluation", """
    WITH s AS (SELECT host, metric, ts, value, lag(value) OVER w AS f, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY host, metric) AS n
      FROM series WINDOW w AS (PARTITION BY host, metric ORDER BY ts))
    SELECT host, metric, count(*) AS n, round(avg(abs(value - f)), 6) AS mae, round(avg((value - f) ** 2), 6) AS mse
    FROM s WHERE rn >= floor(n * 0.8) AND f IS NOT NULL GROUP BY ALL""")
def naive_evaluation(spark, sf):
    from pyspark.sql import Window

    spec = Window.partitionBy(*KEYS).orderBy("ts")
    rows = chrono_split(I.series(spark, sf).withColumn("forecast", F.lag("value").over(spec)), KEYS)
    out = A.regression_metrics(rows.where("part = 'test'"), KEYS, "value", "forecast")
    return out.select(*KEYS, "n", r6("mae").alias("mae"), r6("mse").alias("mse"))


# ---- streams ---------------------------------------------------------------------------------------
def _feed(spark, sf):
    """Events as a stream of raw series points."""
    events = I.table(spark, sf, "events")
    feed = feeds.stream_points(spark, sf, events.schema, "events.parquet")
    names = F.create_map(
        *[F.lit(x) for pair in (("click", "cpu_usage"), ("view", "memory_usage"), ("purchase", "disk_usage"),
                                ("signup", "network_rx")) for x in pair]
    )
    return feed.select(
        "event_id", F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("host"),
        F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("network_tx")).alias("metric"), "ts", "value",
    )


_CLOSED = "ts + INTERVAL {size} <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"


@query("stream_stats_60s", f"""
    SELECT * FROM (SELECT host, field AS metric, date_trunc('minute', ts) AS ts, round(avg(value), 6) AS mean, min(value) AS min,
      max(value) AS max, round(stddev_samp(value), 6) AS stdev, count(value) AS n FROM app_points GROUP BY ALL) w
    WHERE {_CLOSED.format(size='1 MINUTE')}""")
def stream_stats_60s(spark, sf):
    out = feeds.run_available(feeds.stream_basic_stats(_feed(spark, sf), KEYS), "stream-stats")
    return _plain_time(out).withColumns({"mean": r6("mean"), "stdev": r6("stdev")})


@query("stream_mean_1h", f"""
    SELECT host, metric, ts, round(value, 6) AS value FROM series WHERE {_CLOSED.format(size='1 HOUR')}""")
def stream_mean_1h(spark, sf):
    out = feeds.run_available(feeds.stream_aggregate_window(_feed(spark, sf), KEYS, "1h"), "stream-mean")
    return _plain_time(out).withColumn("value", r6("value"))


def _plain_time(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names or ("ts",)})


@query("stream_scores", """
    SELECT event_id, round(z, 6) AS zscore, round(q, 6) AS iqr, round(h, 6) AS pattern, round(greatest(z, q, h), 6) AS score FROM (
      SELECT p.event_id,
        CASE WHEN n < 3 OR std = 0 THEN 0 ELSE least(abs(value - mean) / std / 5, 1) END AS z,
        CASE WHEN n < 4 OR q3 = q1 THEN 0 ELSE least(greatest(q1 - 1.5 * (q3 - q1) - value, value - q3 - 1.5 * (q3 - q1), 0) / (q3 - q1) / 1.5, 1) END AS q,
        CASE WHEN coalesce(hour_n, 0) < 3 OR hour_std = 0 THEN 0 ELSE least(abs(value - hour_mean) / hour_std / 5, 1) END AS h
      FROM app_points p JOIN baseline b ON b.host = p.host AND b.metric = p.field
      LEFT JOIN hours h ON h.host = p.host AND h.metric = p.field AND h.hour = hour(p.ts)) s""")
def stream_scores(spark, sf):
    series = I.series(spark, sf)
    stats = _stored(K.series_baseline(series), "baseline")
    hours = _stored(A.hourly_stats(series), "hours")
    out = feeds.run_available(feeds.stream_score(_feed(spark, sf), stats, hours), "stream-scores")
    return out.select("event_id", *[r6(c).alias(c) for c in ("zscore", "iqr", "pattern", "score")])


def _stored(df, name):
    """Baselines as a stored table, as a running stream would read them."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@query("stream_rule_alerts", """
    SELECT host, field AS metric, ts, value, 150::DOUBLE AS threshold, 'warning' AS severity FROM app_points
    WHERE field = 'cpu_usage' AND value > 150""")
def stream_rule_alerts(spark, sf):
    rules = L.rules_table(spark, [(None, "cpu_usage", "gt", 150.0, "warning", 5)])
    out = feeds.run_available(feeds.stream_alerts(_feed(spark, sf), rules), "stream-alerts")
    return _plain_time(out).select("host", "metric", "ts", "value", "threshold", "severity")


@query("stream_sliding_hour_stats", f"""
    WITH k AS (SELECT unnest(range(6)) AS k)
    SELECT * FROM (SELECT host, metric, ts, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (
      SELECT host, field AS metric, make_timestamp((epoch_us(p.ts) // 600000000 - k) * 600000000) AS ts, value FROM app_points p, k) s
      GROUP BY ALL) w WHERE {_CLOSED.format(size='1 HOUR')}""")
def stream_sliding_hour_stats(spark, sf):
    out = feeds.run_available(feeds.sliding_stats(_feed(spark, sf), KEYS, "60 minutes", "10 minutes"), "stream-sliding")
    return _plain_time(out).withColumns({"mean": r6("mean"), "std": r6("std")})


_PASSED = "epoch_us({ts}) // 1000 < (SELECT epoch_us(max(ts)) // 1000 - 600000 FROM {table})"


@query("stream_quota", """
    WITH RECURSIVE k AS (SELECT client, ts, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM requests),
    w AS (SELECT client, rn, sec AS since, 1::DOUBLE AS tokens, true AS allowed, 0 AS retry_after FROM k WHERE rn = 1
      UNION ALL SELECT client, rn, CASE WHEN lvl >= 1 THEN sec ELSE since END, CASE WHEN lvl >= 1 THEN lvl - 1 ELSE tokens END, lvl >= 1,
        CASE WHEN lvl >= 1 THEN 0 ELSE CAST(floor((1 - lvl) / 0.0005::DOUBLE) AS INTEGER) + 1 END FROM (
        SELECT k.client, k.rn, k.sec, w.since, w.tokens, least(2, w.tokens + (k.sec - w.since) * 0.0005::DOUBLE) AS lvl
        FROM w JOIN k ON k.client = w.client AND k.rn = w.rn + 1) x)
    SELECT k.client, k.ts, w.allowed, w.retry_after FROM k JOIN w USING (client, rn)""")
def stream_quota(spark, sf):
    feed = _feed(spark, sf).select(F.col("host").alias("client"), "ts")
    return _plain_time(feeds.run_to_end(feed, lambda rows: stream_token_bucket(rows, "client", capacity=2, rate=1 / 2000), "stream-quota"))



@query("stream_sustained", f"""
    WITH f AS (SELECT host, field AS metric, ts, CAST(event_id AS VARCHAR) AS tie, value, value > 30 AS hit FROM app_points
      WHERE {_PASSED.format(ts='ts', table='events')}),
    m AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER w, false) THEN 1 ELSE 0 END AS b FROM f
      WINDOW w AS (PARTITION BY host, metric ORDER BY ts, tie)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY host, metric ORDER BY ts, tie ROWS UNBOUNDED PRECEDING) AS run FROM m),
    h AS (SELECT host, metric, run, ts, tie, min(ts) OVER o AS run_start, count(*) OVER o AS points, max(value) OVER o AS max_value
      FROM g WHERE hit WINDOW o AS (PARTITION BY host, metric, run ORDER BY ts, tie ROWS UNBOUNDED PRECEDING))
    SELECT host, metric, run_start, ts AS raised_at, points, max_value FROM h WHERE ts - run_start >= INTERVAL 6 HOUR
    QUALIFY row_number() OVER (PARTITION BY host, metric, run ORDER BY ts, tie) = 1""")
def stream_sustained(spark, sf):
    out = O.stream_sustained(_feed(spark, sf), KEYS, F.col("value") > 30, "6 hours")
    return _plain_time(feeds.run_available(out, "stream-sustained"), "run_start", "raised_at")


@query("stream_downtime", f"""
    SELECT host, metric, ts AS last_seen, ts + INTERVAL 6 HOUR AS down_at FROM (
      SELECT host, field AS metric, ts, lead(ts) OVER (PARTITION BY host, field ORDER BY ts) AS later FROM app_points) x
    WHERE (later IS NULL OR later - ts > INTERVAL 6 HOUR) AND {_PASSED.format(ts='ts + INTERVAL 6 HOUR', table='events')}""")
def stream_downtime(spark, sf):
    out = O.stream_downtime(_feed(spark, sf), KEYS, "6 hours")
    return _plain_time(feeds.run_available(out, "stream-downtime"), "last_seen", "down_at")


@query("stream_cooldown", f"""
    WITH RECURSIVE high AS (SELECT event_id, host, field AS metric, ts, value FROM app_points WHERE value > 60),
    k AS (SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY ts, CAST(event_id AS VARCHAR)) AS rn FROM high
      WHERE {_PASSED.format(ts='ts', table='high')}),
    w AS (SELECT host, metric, rn, ts AS last, true AS emit FROM k WHERE rn = 1
      UNION ALL SELECT k.host, k.metric, k.rn, CASE WHEN k.ts >= w.last + INTERVAL 1 DAY THEN k.ts ELSE w.last END,
        k.ts >= w.last + INTERVAL 1 DAY FROM w JOIN k ON k.host = w.host AND k.metric = w.metric AND k.rn = w.rn + 1)
    SELECT k.event_id, k.host, k.metric, k.ts, k.value FROM k JOIN w USING (host, metric, rn) WHERE emit""")
def stream_cooldown(spark, sf):
    out = O.stream_cooldown(_feed(spark, sf).where("value > 60"), KEYS, "1 day", "event_id")
    return _plain_time(feeds.run_available(out, "stream-cooldown"))


@query("stream_rounded_points", """
    SELECT event_id, make_timestamp((epoch_us(ts) // 10000000) * 10000000) AS ts, value FROM app_points""")
def stream_rounded_points(spark, sf):
    out = feeds.run_available(feeds.rounded(_feed(spark, sf)).select("event_id", "ts", "value"), "stream-rounded")
    return _plain_time(out)


@query("stream_cycle_batches", """
    SELECT host, metric, count(*) AS points, round(sum(value), 6) AS total FROM (
      SELECT host, field AS metric, value FROM app_points) p GROUP BY ALL""")
def stream_cycle_batches(spark, sf):
    path = shared_dir(spark, "cycle-points")

    def cycle(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run = feeds.stream_cycle(_feed(spark, sf), cycle, shared_dir(spark, "cycle-log"), available_now=True)
    run.awaitTermination()
    written = spark.read.parquet(path)
    return written.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("points"), r6(F.sum("value")).alias("total"))
