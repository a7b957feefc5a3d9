"""Scalar expressions, filters, pivots, alignment, spines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import reshape as R
from pulsegrid.operators import windows as W
from pulsegrid.plans import inputs as I
from pulsegrid.plans import jobs
from pulsegrid.plans.registry import query
from pulsegrid.sources import ingest as G
from pulsegrid.sources import points as P

r6 = I.r6
CPU = ["usage_user", "usage_system"]
WIDE = ["cpu_usage_user", "cpu_usage_system", "mem_used_percent", "disk_used_percent"]


@query("filter_fields", """
    SELECT event_id, host, field, value FROM points
    WHERE measurement = 'cpu' AND (field = 'usage_user' OR field = 'usage_system') AND host = 'h2'""")
def filter_fields(spark, sf):
    rows = P.select_points(I.points(spark, sf), measurement="cpu", host="h2", fields=CPU)
    return rows.select("event_id", "host", "field", "value")


@query("allowed_fields", """
    SELECT event_id, measurement, field FROM points WHERE (measurement, field) IN (
      ('cpu', 'usage_user'), ('cpu', 'usage_system'), ('mem', 'used_percent'), ('disk', 'used_percent'),
      ('net', 'bytes_recv'), ('net', 'bytes_sent'), ('system', 'load1'))""")
def allowed_fields(spark, sf):
    return R.allow_fields(I.points(spark, sf), schema.COLLECTED_FIELDS).select("event_id", "measurement", "field")


@query("allowed_fields_table", """
    SELECT event_id, measurement, field FROM points
    WHERE (measurement = 'cpu' AND field = 'usage_user') OR (measurement = 'net' AND field = 'bytes_sent')""")
def allowed_fields_table(spark, sf):
    spec = R.literal_table(spark, [("cpu", "usage_user"), ("net", "bytes_sent")], "measurement string, field string")
    return R.allow_fields(I.points(spark, sf), spec).select("event_id", "measurement", "field")


@query("tag_filters", """
    WITH t AS (SELECT event_id, measurement,
      CASE event_id % 5 WHEN 0 THEN 'tmpfs' WHEN 1 THEN 'overlay' WHEN 2 THEN 'ext4' WHEN 3 THEN 'xfs' END AS fstype,
      CASE event_id % 3 WHEN 0 THEN 'eth0' WHEN 1 THEN 'lo' END AS interface FROM points)
    SELECT event_id, measurement, fstype, interface FROM t
    WHERE (measurement <> 'disk' OR fstype IS NULL OR fstype NOT IN ('tmpfs', 'devtmpfs', 'overlay', 'squashfs'))
      AND (measurement <> 'net' OR (interface IS NOT NULL AND interface IN ('eth0', 'enp0s3', 'en0', 'wlan0')))""")
def tag_filters(spark, sf):
    number = F.col("event_id") % 5
    fstype = F.when(number == 0, "tmpfs").when(number == 1, "overlay").when(number == 2, "ext4").when(number == 3, "xfs")
    third = F.col("event_id") % 3
    tagged = I.points(spark, sf).withColumns(
        {"fstype": fstype, "interface": F.when(third == 0, "eth0").when(third == 1, "lo")}
    )
    return R.collection_filters(tagged).select("event_id", "measurement", "fstype", "interface")


@query("denied_tags_table", """
    SELECT event_id, host FROM points WHERE host NOT IN ('h0', 'h3')""")
def denied_tags_table(spark, sf):
    deny = R.literal_table(spark, [("h0",), ("h3",)], "host string")
    return R.filter_tags(I.points(spark, sf), "host", deny=deny).select("event_id", "host")


@query("converted_fields", """
    SELECT event_id, CAST(trunc(value * 10) AS BIGINT) AS bytes_sent, value AS used_percent,
      CAST(NULL AS BIGINT) AS bytes_recv FROM points""")
def converted_fields(spark, sf):
    wide = I.points(spark, sf).select(
        "event_id", (F.col("value") * 10).alias("bytes_sent"), F.col("value").cast("string").alias("used_percent"),
        F.lit("n/a").alias("bytes_recv"),
    )
    return R.convert_fields(wide, schema.INTEGER_FIELDS, schema.FLOAT_FIELDS)


@query("pressure", """
    WITH w AS (SELECT host, date_trunc('hour', ts) AS ts, avg(value) FILTER (field = 'usage_user') AS u,
        avg(value) FILTER (field = 'usage_system') AS s, avg(value) FILTER (field = 'used_percent') AS p
      FROM points WHERE field IN ('usage_user', 'usage_system', 'used_percent') GROUP BY ALL)
    SELECT host, ts, round(CASE WHEN u IS NOT NULL THEN u + s END, 6) AS cpu_pressure,
      round(greatest(0, p - 80) / 20, 6) AS mem_pressure, round(coalesce(u + s, u), 6) AS cpu_total FROM w""")
def pressure(spark, sf):
    rows = I.points(spark, sf).withColumn("ts", X.hour_start(F.col("ts")))
    wide = R.pivot_fields(rows, ["host", "ts"], [*CPU, "used_percent"])
    out = R.cpu_total(R.derive_pressure(wide))
    # greatest() skips nulls in both engines, so an hour without memory data shows 0.
    return out.select("host", "ts", *[r6(c).alias(c) for c in ("cpu_pressure", "mem_pressure", "cpu_total")])


@query("risk_levels", """
    SELECT event_id, CASE WHEN value / 100 > 0.7 THEN 'critical' WHEN value / 100 > 0.5 THEN 'warning' ELSE 'normal' END AS level,
      CASE WHEN value / 100 > 0.7 THEN 2 WHEN value / 100 > 0.5 THEN 1 ELSE 0 END AS level_num,
      CASE WHEN value / 100 >= 0.9 THEN 'critical' WHEN value / 100 >= 0.8 THEN 'warning'
        WHEN value / 100 >= 0.7 THEN 'info' END AS severity,
      CASE WHEN value / 100 > 0.8 THEN 'critical' WHEN value / 100 > 0.8::DOUBLE * 0.7::DOUBLE THEN 'warning' ELSE 'healthy' END AS status,
      CASE WHEN value / 100 > 0.8 THEN 'critical' WHEN value / 100 > 0.5 THEN 'warning' ELSE 'healthy' END AS health
    FROM points""")
def risk_levels(spark, sf):
    ratio = F.col("value") / 100
    level = X.risk_level(ratio)
    return I.points(spark, sf).select(
        "event_id", level.alias("level"), X.level_num(level).alias("level_num"),
        X.severity_of_ratio(ratio).alias("severity"), X.prob_status(ratio).alias("status"),
        X.disk_health(ratio).alias("health"),
    )


@query("calendar_parts", """
    SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE) AS day, strftime(ts, '%Y-%m-%d') AS day_text,
      round(least(greatest(value, 10), 90), 2) AS clamped FROM events""")
def calendar_parts(spark, sf):
    return I.table(spark, sf, "events").select(
        "event_id", F.hour("ts").alias("hour"), F.to_date("ts").alias("day"),
        F.date_format("ts", "yyyy-MM-dd").alias("day_text"),
        F.round(X.clamp(F.col("value"), 10, 90), 2).alias("clamped"),
    )


@query("alert_messages", """
    SELECT id, metric || ' at ' || printf('%.2f', value) || ' is beyond its limit of ' || printf('%.2f', threshold) AS message
    FROM alerts""")
def alert_messages(spark, sf):
    message = X.exceeds_message(F.col("metric"), F.col("value"), F.col("threshold"))
    return I.alerts(spark, sf).select("id", message.alias("message"))


@query("active_attributes", """
    SELECT device, ts, concat_ws(',', CASE WHEN reallocated_sector_ct > 0 THEN 'reallocated_sector_ct' END,
      CASE WHEN pending_sector_ct > 0 THEN 'pending_sector_ct' END,
      CASE WHEN uncorrectable_errors > 0 THEN 'uncorrectable_errors' END) AS active FROM smart""")
def active_attributes(spark, sf):
    names = ["reallocated_sector_ct", "pending_sector_ct", "uncorrectable_errors"]
    return I.smart(spark, sf).select("device", "ts", F.array_join(X.active_attributes(names), ",").alias("active"))


@query("features_zero_filled", """
    SELECT device, ts, CAST(power_on_hours AS DOUBLE) AS power_on_hours, CAST(0 AS DOUBLE) AS temperature,
      CAST(coalesce(nullif(pending_sector_ct, 0), 0) AS DOUBLE) AS pending_sector_ct FROM smart""")
def features_zero_filled(spark, sf):
    names = ["power_on_hours", "temperature", "pending_sector_ct"]
    rows = I.smart(spark, sf).withColumn("pending_sector_ct", F.nullif("pending_sector_ct", F.lit(0)))
    return R.feature_policy(rows, names, "zero").select("device", "ts", *names)


@query("compare_by_name", """
    SELECT id, op, CASE op WHEN 'gt' THEN value > 150 WHEN 'lt' THEN value < 150 WHEN 'eq' THEN value = 150
      WHEN 'gte' THEN value >= 150 WHEN 'lte' THEN value <= 150 END AS holds
    FROM (SELECT id, value, CASE id % 6 WHEN 0 THEN 'gt' WHEN 1 THEN 'lt' WHEN 2 THEN 'eq' WHEN 3 THEN 'gte'
      WHEN 4 THEN 'lte' ELSE 'other' END AS op FROM alerts) a""")
def compare_by_name(spark, sf):
    names = F.array(*[F.lit(n) for n in ("gt", "lt", "eq", "gte", "lte", "other")])
    rows = I.alerts(spark, sf).withColumn("op", F.element_at(names, (F.col("id") % 6 + 1).cast("int")))
    return rows.select("id", "op", X.compare(F.col("value"), F.col("op"), F.lit(150.0)).alias("holds"))


_REQUEST_SQL = """
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' ELSE host END AS host, measurement AS metric_type,
      CASE WHEN event_id % 7 = 0 THEN 'median' ELSE 'mean' END AS aggregation,
      CASE WHEN event_id % 5 = 0 THEN '1 minute' ELSE '1m' END AS "window", event_id % 12000 AS "limit" FROM points"""


def _request_rows(spark, sf):
    number = F.col("event_id")
    return I.points(spark, sf).select(
        "event_id",
        F.when(number % 11 == 0, "").otherwise(F.col("host")).alias("host"),
        F.col("measurement").alias("metric_type"),
        F.when(number % 7 == 0, "median").otherwise("mean").alias("aggregation"),
        F.when(number % 5 == 0, "1 minute").otherwise("1m").alias("window"),
        (number % 12000).alias("limit"),
    )


@query("valid_requests", f"""
    SELECT * FROM ({_REQUEST_SQL}) q WHERE length(host) BETWEEN 1 AND 255 AND aggregation = 'mean' AND "window" = '1m'
      AND "limit" BETWEEN 1 AND 10000""")
def valid_requests(spark, sf):
    return G.validate_rows(_request_rows(spark, sf), G.query_rules())[0]


@query("rejected_requests", f"""
    SELECT event_id, reason FROM (
      SELECT event_id, CASE WHEN length(host) = 0 THEN 'host' WHEN aggregation <> 'mean' THEN 'aggregation'
        WHEN "window" <> '1m' THEN 'window' WHEN "limit" NOT BETWEEN 1 AND 10000 THEN 'limit' END AS reason
      FROM ({_REQUEST_SQL}) q) x WHERE reason IS NOT NULL""")
def rejected_requests(spark, sf):
    return G.validate_rows(_request_rows(spark, sf), G.query_rules())[1].select("event_id", "reason")


@query("numeric_means", """
    SELECT round(avg(device), 6) AS device, round(avg(reallocated_sector_ct), 6) AS reallocated_sector_ct,
      round(avg(pending_sector_ct), 6) AS pending_sector_ct FROM smart""")
def numeric_means(spark, sf):
    rows = I.smart(spark, sf)
    return rows.agg(*[r6(F.avg(c)).alias(c) for c in R.numeric_cols(rows, 3)])


@query("pivot_cpu", """
    SELECT host, date_trunc('hour', ts) AS ts, round(avg(value) FILTER (field = 'usage_user'), 6) AS cpu_usage_user,
      round(avg(value) FILTER (field = 'usage_system'), 6) AS cpu_usage_system
    FROM points WHERE measurement = 'cpu' GROUP BY ALL""")
def pivot_cpu(spark, sf):
    rows = P.select_points(I.points(spark, sf), measurement="cpu").withColumn("ts", X.hour_start(F.col("ts")))
    wide = R.pivot_fields(rows, ["host", "ts"], CPU)
    named = R.prefix_columns(wide, "cpu", ("host", "ts"))
    return named.select("host", "ts", *[r6(c).alias(c) for c in ("cpu_usage_user", "cpu_usage_system")])


_WIDE_SQL = """
    SELECT host, date_trunc('hour', ts) AS ts,
      avg(value) FILTER (measurement = 'cpu' AND field = 'usage_user') AS cpu_usage_user,
      avg(value) FILTER (measurement = 'cpu' AND field = 'usage_system') AS cpu_usage_system,
      avg(value) FILTER (measurement = 'mem') AS mem_used_percent,
      avg(value) FILTER (measurement = 'disk') AS disk_used_percent
    FROM points WHERE measurement IN ('cpu', 'mem', 'disk') GROUP BY ALL"""


def _hourly_wide(spark, sf):
    rows = I.points(spark, sf).withColumn("ts", X.hour_start(F.col("ts")))
    return R.pivot_fields(rows, ["host", "ts"], WIDE, R.measurement_field())


@query("pivot_measurement_field", f"""
    SELECT host, ts, round(coalesce(cpu_usage_user, 0), 6) AS cpu_usage_user,
      round(coalesce(cpu_usage_system, 0), 6) AS cpu_usage_system,
      round(coalesce(mem_used_percent, 0), 6) AS mem_used_percent,
      round(coalesce(disk_used_percent, 0), 6) AS disk_used_percent FROM ({_WIDE_SQL}) w""")
def pivot_measurement_field(spark, sf):
    wide = R.fill_const(_hourly_wide(spark, sf), {c: 0.0 for c in WIDE})
    return wide.select("host", "ts", *[r6(c).alias(c) for c in WIDE])


@query("align_frames", f"SELECT host, ts, {', '.join(f'round({c}, 6) AS {c}' for c in WIDE)} FROM ({_WIDE_SQL}) w")
def align_frames(spark, sf):
    rows = I.points(spark, sf).withColumn("ts", X.hour_start(F.col("ts")))
    frames = []
    for name, fields in (("cpu", CPU), ("mem", ["used_percent"]), ("disk", ["used_percent"])):
        part = rows.where(F.col("measurement") == name)
        frames.append((name, R.pivot_fields(part, ["host", "ts"], fields)))
    return R.align(frames, ["host", "ts"]).select("host", "ts", *[r6(c).alias(c) for c in WIDE])


@query("unpivot_wide", f"""
    SELECT host, ts, field, round(value, 6) AS value FROM (UNPIVOT ({_WIDE_SQL})
      ON {', '.join(WIDE)} INTO NAME field VALUE value) u""")
def unpivot_wide(spark, sf):
    long = R.unpivot_fields(_hourly_wide(spark, sf), ["host", "ts"], WIDE)
    return long.withColumn("value", r6("value"))


@query("regular_hours", """
    SELECT g.host, g.metric, g.ts, round(s.value, 6) AS value FROM (
      SELECT host, metric, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY host, metric) g
    LEFT JOIN series s ON s.host = g.host AND s.metric = g.metric AND s.ts = g.ts""")
def regular_hours(spark, sf):
    return R.regularize(I.series(spark, sf), ["host", "metric"], "1 hour").withColumn("value", r6("value"))


@query("hour_spine_profile", "SELECT host, metric, CAST(hour AS INTEGER) AS hour, round(profile, 6) AS profile FROM profile")
def hour_spine_profile(spark, sf):
    return A.hourly_profile(I.series(spark, sf)).withColumn("profile", r6("profile"))


@query("exploded_metric_map", """
    SELECT host, CAST(hour AS INTEGER) AS hour, metric, round(risk, 6) AS risk FROM risk_table""")
def exploded_metric_map(spark, sf):
    from pulsegrid.operators.risk import with_metric_map

    tables = jobs.ensemble_job(I.app_points(spark, sf))
    nested = with_metric_map(tables.risk, tables.overall, ["risk", "level"])
    return R.explode_metrics(nested).select("host", "hour", "metric", r6("risk").alias("risk"))


@query("last_values", """
    SELECT host, measurement, field, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM points GROUP BY ALL""")
def last_values(spark, sf):
    return A.last_per_series(I.points(spark, sf), list(schema.POINT_KEYS), ["ts", "event_id"], ["ts", "value"])


@query("minute_grid_filled", """
    WITH w AS (SELECT host, date_trunc('minute', ts) AS ts, avg(value) FILTER (measurement = 'cpu' AND field = 'usage_user') AS c,
        avg(value) FILTER (measurement = 'mem') AS m
      FROM points WHERE (measurement = 'cpu' AND field = 'usage_user') OR measurement = 'mem' GROUP BY ALL),
    g AS (SELECT host, unnest(generate_series(min(ts), max(ts), INTERVAL 1 MINUTE)) AS ts FROM w GROUP BY host),
    j AS (SELECT g.host, g.ts, w.c, w.m FROM g LEFT JOIN w USING (host, ts))
    SELECT host, ts, round(coalesce(last_value(c IGNORE NULLS) OVER a, first_value(c IGNORE NULLS) OVER b), 6) AS cpu_usage_user,
      round(coalesce(last_value(m IGNORE NULLS) OVER a, first_value(m IGNORE NULLS) OVER b), 6) AS mem_used_percent
    FROM j WINDOW a AS (PARTITION BY host ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      b AS (PARTITION BY host ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def minute_grid_filled(spark, sf):
    fields = ["cpu_usage_user", "mem_used_percent"]
    grid = jobs.aligned_frame(I.points(spark, sf), fields)
    return grid.select("host", "ts", *[r6(c).alias(c) for c in fields])


@query("query_metrics_cpu", """
    WITH m AS (SELECT host, date_trunc('hour', ts) AS ts, max(value) FILTER (field = 'usage_user') AS usage_user,
        max(value) FILTER (field = 'usage_system') AS usage_system
      FROM points WHERE measurement = 'cpu' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts) AS rn FROM m)
    SELECT host, ts, usage_user, usage_system FROM k WHERE rn <= 100""")
def query_metrics_cpu(spark, sf):
    return jobs.query_metrics(
        I.points(spark, sf), "cpu", CPU, "2024-01-03 00:00:00", "2024-01-25 00:00:00", aggregation="max",
        window="1h", limit=100,
    )


@query("public_columns", """
    SELECT event_id, ts AS "timestamp", host, value FROM points""")
def public_columns(spark, sf):
    rows = I.points(spark, sf).withColumnsRenamed({"ts": "_time", "measurement": "_measurement", "field": "_field"})
    return R.public_columns(rows)


@query("retained_rows", """
    SELECT event_id, ts FROM points WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY""")
def retained_rows(spark, sf):
    from pulsegrid.streaming.feeds import retain

    return retain(I.points(spark, sf), I.NOW, 10).select("event_id", "ts")


@query("hash_split_sizes", """
    SELECT measurement, count(*) AS points, true AS about_a_fifth FROM points GROUP BY measurement""")
def hash_split_sizes(spark, sf):
    split = W.hash_split(I.points(spark, sf), ["event_id"])
    share = F.avg((F.col("part") == "test").cast("int"))
    return split.groupBy("measurement").agg(
        F.count(F.lit(1)).alias("points"), share.between(0.1, 0.3).alias("about_a_fifth")
    )
