"""Alert rules, listings, sustained conditions, gaps, cooldown, dashboard, quota."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators.ordered import union_all
from pulsegrid.plans import inputs as I
from pulsegrid.plans.registry import query
from pulsegrid.sources import ingest as G
from pulsegrid.sources.points import lookback
from pulsegrid.streaming.quota import token_bucket

r6 = I.r6
ORDER = ["ts", "event_id"]


def _values(spark, sf):
    """Per host: newest CPU value, share of high values, worst disk score."""
    from pulsegrid.operators.disk import score_disks

    rows = I.points(spark, sf)
    cpu = rows.where("measurement = 'cpu'").groupBy("host").agg(
        F.lit("cpu_usage").alias("metric"), F.max("value").alias("value")
    )
    rate = rows.groupBy("host").agg(
        F.lit("anomaly_rate").alias("metric"), F.avg((F.col("value") > 60).cast("int")).alias("value")
    )
    disks = score_disks(I.smart(spark, sf)).withColumn("host", F.concat(F.lit("h"), (F.col("device") % 4).cast("string")))
    worst = disks.groupBy("host").agg(F.lit("disk_failure").alias("metric"), F.max("failure_probability").alias("value"))
    return union_all([cpu, rate, worst])


_VALUES_SQL = """
    SELECT host, 'cpu_usage' AS metric, max(value) AS value FROM points WHERE measurement = 'cpu' GROUP BY host
    UNION ALL SELECT host, 'anomaly_rate', avg(CASE WHEN value > 60 THEN 1 ELSE 0 END) FROM points GROUP BY host
    UNION ALL SELECT concat('h', CAST(device % 4 AS VARCHAR)), 'disk_failure', max(failure_probability) FROM disk_scored GROUP BY 1"""


@query("default_rule_alerts", f"""
    SELECT host, metric, round(value, 6) AS value, threshold, severity FROM (
      SELECT *, CASE metric WHEN 'cpu_usage' THEN 90::DOUBLE WHEN 'anomaly_rate' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS threshold,
        CASE metric WHEN 'cpu_usage' THEN 'warning' ELSE 'critical' END AS severity FROM ({_VALUES_SQL}) v) x
    WHERE value > threshold""")
def default_rule_alerts(spark, sf):
    broken = L.evaluate_rules(_values(spark, sf), L.rules_table(spark))
    return broken.select("host", "metric", r6("value").alias("value"), "threshold", "severity")


@query("configured_rule_alerts", """
    SELECT event_id, host, field AS metric, value, threshold, severity FROM app_points p JOIN (VALUES
      (NULL, 'cpu_usage', 'gt', 120::DOUBLE, 'warning'), ('h1', 'memory_usage', 'gte', 50::DOUBLE, 'info'),
      (NULL, 'disk_usage', 'lt', 1::DOUBLE, 'critical'), ('h2', 'network_rx', 'lte', 0.5::DOUBLE, 'info')) r(rh, rm, op, threshold, severity)
      ON rm = field AND (rh IS NULL OR rh = host)
    WHERE CASE op WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold WHEN 'lt' THEN value < threshold
      ELSE value <= threshold END""")
def configured_rule_alerts(spark, sf):
    rules = [
        (None, "cpu_usage", "gt", 120.0, "warning", 5),
        ("h1", "memory_usage", "gte", 50.0, "info", 5),
        (None, "disk_usage", "lt", 1.0, "critical", 5),
        ("h2", "network_rx", "lte", 0.5, "info", 5),
    ]
    broken = L.evaluate_rules(I.raw_series(spark, sf), L.rules_table(spark, rules))
    return broken.select("event_id", "host", "metric", "value", "threshold", "severity")


@query("active_alerts", """
    SELECT CAST(id AS VARCHAR) AS id, host, metric, value, threshold, severity, ts FROM alerts
    WHERE status = 'active' AND host = 'h1' AND severity = 'warning'
      AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 20 DAY AND ts < TIMESTAMP '2024-01-30' ORDER BY ts, id LIMIT 5""")
def active_alerts(spark, sf):
    rows = L.active_alerts(I.alerts(spark, sf), I.NOW, "h1", "warning", 5, "20 days")
    return rows.drop("message")


@query("active_alerts_all", """
    SELECT CAST(id AS VARCHAR) AS id, host, metric, value, threshold, severity, ts FROM alerts
    WHERE status = 'active' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND ts < TIMESTAMP '2024-01-30'""")
def active_alerts_all(spark, sf):
    return L.active_alerts(I.alerts(spark, sf), I.NOW, limit=None).drop("message")


@query("alert_counts", """
    SELECT host, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'active' AND severity = 'critical') AS critical,
      count(*) FILTER (status = 'active' AND severity = 'warning') AS warning FROM alerts GROUP BY host""")
def alert_counts(spark, sf):
    return A.alert_counts(I.alerts(spark, sf))


@query("sustained_high_memory", """
    WITH f AS (SELECT host, ts, event_id, value, value > 40 AS hit FROM points WHERE measurement = 'mem'),
    m AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER w, false) THEN 1 ELSE 0 END AS b FROM f
      WINDOW w AS (PARTITION BY host ORDER BY ts, event_id)),
    g AS (SELECT *, sum(b) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT host, min(ts) AS run_start, max(ts) AS run_end, count(*) AS points, max(value) AS max_value FROM g WHERE hit
    GROUP BY host, run HAVING max(ts) - min(ts) >= INTERVAL 10 MINUTE""")
def sustained_high_memory(spark, sf):
    rows = I.points(spark, sf).where("measurement = 'mem'").select("host", "ts", "event_id", "value")
    return L.sustained(rows, ["host"], ORDER, F.col("value") > 40, "10 minutes")


@query("silent_series", """
    SELECT host, measurement, field, p AS gap_start, ts AS gap_end, round((epoch_us(ts) - epoch_us(p)) / 1e6, 6) AS gap_seconds FROM (
      SELECT host, measurement, field, ts, lag(ts) OVER (PARTITION BY host, measurement, field ORDER BY ts, event_id) AS p FROM points) x
    WHERE ts - p > INTERVAL 6 HOUR""")
def silent_series(spark, sf):
    out = L.gaps(I.points(spark, sf), list(schema.POINT_KEYS), ORDER, "6 hours")
    return out.withColumn("gap_seconds", r6("gap_seconds"))


@query("silent_hosts_2m", """
    SELECT host, p AS gap_start, ts AS gap_end FROM (
      SELECT host, ts, lag(ts) OVER (PARTITION BY host ORDER BY ts, event_id) AS p FROM points) x WHERE ts - p > INTERVAL 2 MINUTE""")
def silent_hosts_2m(spark, sf):
    return L.gaps(I.points(spark, sf), ["host"], ORDER, "2m").drop("gap_seconds")


@query("cooled_alerts", """
    WITH RECURSIVE k AS (SELECT id, host, metric, ts, row_number() OVER (PARTITION BY host, metric ORDER BY ts, id) AS rn FROM alerts),
    w AS (SELECT host, metric, rn, ts AS last, true AS emit FROM k WHERE rn = 1
      UNION ALL SELECT k.host, k.metric, k.rn, CASE WHEN k.ts >= w.last + INTERVAL 6 HOUR THEN k.ts ELSE w.last END,
        k.ts >= w.last + INTERVAL 6 HOUR FROM w JOIN k ON k.host = w.host AND k.metric = w.metric AND k.rn = w.rn + 1)
    SELECT k.id, k.host, k.metric, k.ts FROM k JOIN w USING (host, metric, rn) WHERE emit""")
def cooled_alerts(spark, sf):
    return L.cooldown(I.alerts(spark, sf), ["host", "metric"], 6 * 3600).select("id", "host", "metric", "ts")


@query("grouped_alerts", """
    WITH g AS (SELECT id, host, make_timestamp((epoch_us(ts) // 86400000000) * 86400000000) AS group_start, ts FROM alerts),
    r AS (SELECT *, row_number() OVER (PARTITION BY host, group_start ORDER BY ts, id) AS rn,
      count(*) OVER (PARTITION BY host, group_start) AS group_size FROM g)
    SELECT id, host, group_start, CAST(rn AS INTEGER) AS rank, group_size FROM r WHERE rn <= 3""")
def grouped_alerts(spark, sf):
    out = L.group_alerts(I.alerts(spark, sf), ["host"], ["ts", "id"], "1 day", 3)
    return out.select("id", "host", "group_start", "rank", "group_size")


@query("grouped_alerts_300s", """
    WITH g AS (SELECT id, host, ts, make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS group_start FROM alerts),
    r AS (SELECT *, row_number() OVER (PARTITION BY host, group_start ORDER BY ts, id) AS rn,
      count(*) OVER (PARTITION BY host, group_start) AS group_size FROM g)
    SELECT id, host, group_start, CAST(rn AS INTEGER) AS rank, group_size FROM r WHERE rn <= 10""")
def grouped_alerts_300s(spark, sf):
    out = L.group_alerts(I.alerts(spark, sf), ["host"], ["ts", "id"])
    return out.select("id", "host", "group_start", "rank", "group_size")


@query("down_hosts", """
    SELECT host, measurement, field, last_seen, round((epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last_seen)) / 1e6, 6) AS silent_seconds
    FROM (SELECT host, measurement, field, max(ts) AS last_seen FROM points WHERE ts < TIMESTAMP '2024-01-30' GROUP BY ALL) l
    WHERE TIMESTAMP '2024-01-30' - last_seen > INTERVAL 2 MINUTE""")
def down_hosts(spark, sf):
    out = L.down(I.points(spark, sf), list(schema.POINT_KEYS), I.NOW, "2m")
    return out.withColumn("silent_seconds", r6("silent_seconds"))


_RULES_SQL = """
    SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('h', CAST(user_id % 4 AS VARCHAR)) END AS host, event_type AS metric,
      CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS threshold, CASE event_id % 6 WHEN 0 THEN 'gt' WHEN 1 THEN 'lt' WHEN 2 THEN 'eq'
        WHEN 3 THEN 'gte' WHEN 4 THEN 'lte' ELSE 'above' END AS operator, CASE WHEN event_id % 5 = 0 THEN 'fatal' ELSE 'warning' END AS severity,
      event_id % 1500 AS cooldown_minutes FROM events"""


def _rule_rows(spark, sf):
    """Alert configuration rows, some of them broken."""
    i = F.col("event_id")
    names = F.array(*[F.lit(o) for o in ("gt", "lt", "eq", "gte", "lte", "above")])
    return I.table(spark, sf, "events").select(
        i.alias("id"), F.when(i % 11 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string"))).alias("host"),
        F.col("event_type").alias("metric"), F.when(i % 7 != 0, F.col("value")).alias("threshold"),
        F.get(names, (i % 6).cast("int")).alias("operator"), F.when(i % 5 == 0, "fatal").otherwise("warning").alias("severity"),
        (i % 1500).alias("cooldown_minutes"),
    )


_REASON_SQL = f"""
    SELECT *, CASE WHEN length(host) = 0 THEN 'host' WHEN metric IS NULL THEN 'metric' WHEN threshold IS NULL THEN 'threshold'
      WHEN operator = 'above' THEN 'operator' WHEN severity = 'fatal' THEN 'severity'
      WHEN cooldown_minutes NOT BETWEEN 1 AND 1440 THEN 'cooldown_minutes' END AS reason FROM ({_RULES_SQL}) r"""


@query("valid_alert_rules", f"SELECT * EXCLUDE (reason) FROM ({_REASON_SQL}) x WHERE reason IS NULL")
def valid_alert_rules(spark, sf):
    return G.validate_rows(_rule_rows(spark, sf), G.alert_rule_rules())[0]


@query("rejected_alert_rules", f"SELECT id, reason FROM ({_REASON_SQL}) x WHERE reason IS NOT NULL")
def rejected_alert_rules(spark, sf):
    return G.validate_rows(_rule_rows(spark, sf), G.alert_rule_rules())[1].select("id", "reason")


@query("rule_messages", f"""
    SELECT host, metric, CASE metric WHEN 'cpu_usage' THEN printf('cpu_usage at %.1f%% is beyond its limit of 90.0%%', value)
      WHEN 'anomaly_rate' THEN printf('anomaly_rate at %.1f%% is beyond its limit of 30.0%%', value * 100)
      ELSE printf('disk_failure at %.1f%% is beyond its limit of 80.0%%', value * 100) END AS message
    FROM ({_VALUES_SQL}) v WHERE value > CASE metric WHEN 'cpu_usage' THEN 90::DOUBLE WHEN 'anomaly_rate' THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END""")
def rule_messages(spark, sf):
    broken = L.evaluate_rules(_values(spark, sf), L.rules_table(spark)).withColumn("ts", F.lit(I.NOW).cast("timestamp_ntz"))
    return L.to_alerts(broken, ["host", "metric", "threshold"]).select("host", "metric", "message")


_DASH_SQL = """
    WITH l AS (SELECT host, measurement, field, arg_max(value, (ts, event_id)) AS value FROM points
      WHERE measurement IN ('cpu', 'mem', 'disk') AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY AND ts < TIMESTAMP '2024-01-30'
      GROUP BY ALL),
    m AS (SELECT host, measurement, avg(value) AS value FROM l GROUP BY ALL)"""


@query("dashboard_metrics", _DASH_SQL + """
    SELECT host, measurement, round(value, 6) AS value, CASE WHEN measurement = 'disk' THEN 'GB' ELSE '%' END AS unit,
      CASE WHEN value < 80 THEN 'normal' WHEN value < 90 THEN 'warning' ELSE 'critical' END AS status,
      CASE WHEN value > 90 THEN 20 WHEN value > 80 THEN 10 ELSE 0 END AS penalty FROM m""")
def dashboard_metrics(spark, sf):
    rows = lookback(I.points(spark, sf), I.NOW, "2 days")
    out = A.dashboard_metrics(rows, ORDER)
    return out.withColumn("value", r6("value"))


@query("dashboard_summary", _DASH_SQL + """
    SELECT host, round(max(value) FILTER (measurement = 'cpu'), 6) AS cpu_value,
      max(CASE WHEN value < 80 THEN 'normal' WHEN value < 90 THEN 'warning' ELSE 'critical' END) FILTER (measurement = 'cpu') AS cpu_status,
      CAST(greatest(0, 100 - sum(CASE WHEN value > 90 THEN 20 WHEN value > 80 THEN 10 ELSE 0 END)) AS INTEGER) AS health_score
    FROM m GROUP BY host""")
def dashboard_summary(spark, sf):
    rows = lookback(I.points(spark, sf), I.NOW, "2 days")
    out = A.dashboard_summary(rows, ORDER)
    return out.select("host", r6("cpu_value").alias("cpu_value"), "cpu_status", "health_score")


@query("dashboard_multi_disk", """
    WITH l AS (SELECT host, measurement, field, tag_set, arg_max(value, (ts, event_id)) AS value FROM tagged_points
      WHERE measurement IN ('cpu', 'mem', 'disk') AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 2 DAY AND ts < TIMESTAMP '2024-01-30'
      GROUP BY ALL)
    SELECT host, measurement, round(avg(value), 6) AS value, CASE WHEN measurement = 'disk' THEN 'GB' ELSE '%' END AS unit,
      CASE WHEN avg(value) < 80 THEN 'normal' WHEN avg(value) < 90 THEN 'warning' ELSE 'critical' END AS status,
      CASE WHEN avg(value) > 90 THEN 20 WHEN avg(value) > 80 THEN 10 ELSE 0 END AS penalty FROM l GROUP BY host, measurement""")
def dashboard_multi_disk(spark, sf):
    rows = lookback(I.tagged_points(spark, sf), I.NOW, "2 days")
    return A.dashboard_metrics(rows, ORDER).withColumn("value", r6("value"))


@query("request_quota", """
    WITH RECURSIVE k AS (SELECT event_id, client, epoch_us(ts) / 1e6 AS sec, row_number() OVER (PARTITION BY client ORDER BY ts, event_id) AS rn FROM requests),
    w AS (SELECT client, rn, sec AS since, 1::DOUBLE AS tokens, true AS allowed FROM k WHERE rn = 1
      UNION ALL SELECT client, rn, CASE WHEN lvl >= 1 THEN sec ELSE since END, CASE WHEN lvl >= 1 THEN lvl - 1 ELSE tokens END, lvl >= 1 FROM (
        SELECT k.client, k.rn, k.sec, w.since, w.tokens, least(2, w.tokens + (k.sec - w.since) / 2000) AS lvl
        FROM w JOIN k ON k.client = w.client AND k.rn = w.rn + 1) x)
    SELECT k.event_id, k.client, w.allowed FROM k JOIN w USING (client, rn)""")
def request_quota(spark, sf):
    out = token_bucket(I.requests(spark, sf), "client", ORDER, capacity=2, rate=1 / 2000)
    return out.select("event_id", "client", "allowed")
