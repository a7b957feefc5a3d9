"""Parsers, ingest, sinks, reshaping."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators import reshape as R
from pulsegrid.operators import risk as K
from pulsegrid.plans import jobs
from pulsegrid.session import materialize, shared_dir
from pulsegrid.sources import ingest as G
from pulsegrid.sources import line_protocol as LP
from pulsegrid.sources import points as P
from pulsegrid.sources import sinks as Z
from pulsegrid.sources import smart_text as ST

NOW = datetime(2024, 1, 2)


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


REPORT = """smartctl 7.2
  9 Ignored_Before_Header 0x0032 100 099 010 Old_age Always - 7
ID# ATTRIBUTE_NAME          FLAG     VALUE WORST THRESH TYPE      UPDATED  WHEN_FAILED RAW_VALUE
  5 Reallocated_Sector_Ct   0x0033   100   099   010    Pre-fail  Always       -       12
=== a banner line with more than ten fields a b c d e f
194 Temperature_Celsius     0x0022   064   050   000    Old_age   Always       -       36 (Min/Max 20/50)
  9 Power_On_Hours          0x0032   abc   099   000    Old_age   Always       -       100
  9 Power_On_Hours          0x0032   100   099   000    Old_age   Always       -       12h+3m
  5 Reallocated_Sector_Ct   0x0033   100   098   010    Pre-fail  Always       -       13
 short line
"""


def test_smart_report(spark):
    df = spark.createDataFrame([("sda", NOW, REPORT), ("sdb", NOW, "no header here")], "device string, ts timestamp_ntz, report string")
    got = {r["attr"]: (r["id"], r["value"], r["worst"], r["threshold"], r["raw"]) for r in ST.parse_smart_reports(df, ["device"]).collect()}
    assert got == {
        "reallocated_sector_ct": (5, 100, 98, 10, "13"),
        "temperature_celsius": (194, 64, 50, 0, "36"),
        "power_on_hours": (9, 100, 99, 0, "12h+3m"),
    }
    lines = {r["device"]: r["line"] for r in jobs.disk_failure_job(df, ["device", "ts"]).collect()}
    ns = 1704153600 * 10**9
    assert lines["sda"] == (
        'disk_failure,device=sda failure_probability=0.13,reallocated_sector_ct=13i,temperature_celsius=36i,'
        f'health_status="healthy" {ns}'
    )
    assert lines["sdb"].startswith("disk_failure,device=sdb failure_probability=0.05,health_status=")


def test_smart_lines_with_odd_room_and_lazy_repeats(spark):
    """Fields are set apart by any room, a tab in front makes an empty one; lines are split once and only repeats are compared."""
    text = "ID# ATTRIBUTE_NAME\r\n" + "\n".join([
        " 1\tA 0 100\t 99 10  p q r \t5\r", "\t2 B 0 100 99 10 p q r 6", "3 C 0 100 99 10 p q r\r", "4 a 0 100 99 10 p q r 9 x",
        "5 D 0 1 2 3 p q ID#ATTRIBUTE_NAME 7", "", "===", "6 E 0 100 99 10 p q r 8  ", "7 E 0 n 99 10 p q r 9"])
    df = spark.createDataFrame([("x", text), ("y", None), ("z", "ID# ATTRIBUTE_NAME")], "device string, report string")
    got = sorted((r["device"], r["id"], r["attr"], r["raw"]) for r in ST.parse_smart_reports(df, ["device"]).collect())
    assert got == [("x", 3, "c", ""), ("x", 4, "a", "9"), ("x", 6, "e", "8")]
    wide = {r["device"]: r[1:] for r in ST.wide_smart_reports(df, ["device"], ["a", "b", "c", "d", "e"]).collect()}
    none = (None,) * 5
    assert wide == {"x": (9, None, None, None, 8), "y": none, "z": none}
    # no regular expression is compiled for every line or report
    plan = ST.parse_smart_reports(df, ["device"])._jdf.queryExecution().optimizedPlan().toString()
    assert "\\s+" not in plan


def test_line_protocol_round_trip_with_special_characters(spark):
    at = datetime(2024, 1, 1, 0, 0, 7, 179575)
    df = spark.createDataFrame(
        [("a b,c=d", None, 1.5, 3, 'say "hi", ok \\', True, at), ("x", "y", None, None, None, None, at)],
        "host string, zone string, f double, n long, s string, b boolean, ts timestamp_ntz",
    )
    lines = LP.to_line_protocol(df, "my measure", ["host", "zone"], ["f", "n", "s", "b"])
    assert lines.count() == 1
    rows = {r["field"]: r for r in LP.parse_line_protocol(lines.select("line")).collect()}
    assert {k: (r["value"], r["text"]) for k, r in rows.items()} == {
        "f": (1.5, None), "n": (3, None), "s": (None, 'say "hi", ok \\'), "b": (1, None)
    }
    assert rows["f"]["tags"] == {"host": "a b,c=d"} and rows["f"]["measurement"] == "my measure"
    assert rows["f"]["ts"] == at


def test_line_protocol_skips_other_text(spark):
    df = spark.createDataFrame([("# comment",), ("",), ("m",), ("m f=1",), ("m,t=1 f=bad,g=2i 5000",)], "line string")
    got = sorted((r["measurement"], r["field"], r["value"], r["ts"]) for r in LP.parse_line_protocol(df).where("value is not null").collect())
    assert got == [("m", "f", 1.0, None), ("m", "g", 2.0, datetime(1970, 1, 1, 0, 0, 0, 5))]


def test_line_protocol_is_matched_once_and_tags_are_read_once_a_line(spark):
    lines = [("a,t=x\\ y f=1,g=\"p\0, q\",h=2i 7000",), ("a,t=z f=b=c 1",), ("a\\,b,t=u f=true  ",), ("a f=x\"y\" 1",)]
    df = spark.createDataFrame(lines, "line string")
    parsed = LP.parse_line_protocol(df)
    got = sorted((r["measurement"], tuple(r["tags"].items()), r["field"], r["value"], r["text"]) for r in parsed.collect())
    assert got == [("a", (("t", "x y"),), "f", 1.0, None), ("a", (("t", "x y"),), "g", None, "p\0, q"),
                   ("a", (("t", "x y"),), "h", 2.0, None), ("a", (("t", "z"),), "f", None, None),
                   ("a,b", (("t", "u"),), "f", 1.0, None)]
    steps = parsed._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, step in enumerate(steps) if "map_from_arrays" in step)
    assert sum("map_from_arrays" in step for step in steps) == 1 and any("explode(_l" in step for step in steps[:at])


BODIES = [
    '{"measurement":"cpu","tags":{"host":"a"},"fields":{"u":1.5,"note":"x"},"timestamp":"2024-01-01T00:00:00Z"}',
    '{"tags":{"host":"a"},"fields":{"u":2}}',
    '{"measurement":"cpu"}',
    "not json",
]


def test_ingest_lenient_and_strict(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(BODIES)], "batch_id long, index long, json string")
    lenient = G.ingest_metrics(df, now(), strict=False)
    rows = sorted((r["measurement"], r["field"], r["value"], r["text"], r["ts"]) for r in lenient.points.fillna("").collect())
    assert rows[0] == ("cpu", "note", None, "x", datetime(2024, 1, 1))
    assert ("custom", "u", 2.0, "", NOW) in rows and len(rows) == 3
    assert [r["index"] for r in lenient.rejects.collect()] == [3]
    strict = G.ingest_metrics(df, now())
    assert sorted(r["index"] for r in strict.rejects.collect()) == [1, 2, 3]
    assert strict.counts.first().asDict() == {"batch_id": 1, "points_written": 1, "errors": 3}
    assert G.ingest_metrics(df, now(), max_batch=3).points.count() == 0


def test_points_table_round_trip_prunes_days(spark):
    rows = [(NOW + timedelta(days=i), "cpu", "h", {"a": "b"}, "u", float(i)) for i in range(5)]
    path = shared_dir(spark, "points-test")
    Z.append_points(spark.createDataFrame(rows, schema.POINTS), path)
    df = P.read_points(spark, path, NOW + timedelta(days=1), NOW + timedelta(days=3), "cpu", "h")
    assert sorted(r["value"] for r in df.collect()) == [1, 2]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThanOrEqual(ts" in plan


def test_durations_are_checked():
    assert [P.duration(t) for t in ("5m", "24h", "300 seconds")] == ["5 minutes", "24 hours", "300 seconds"]
    for bad in ("", "m", "5x", "0m", "1 hour; drop", "٣m", "-1 hours"):
        with pytest.raises(ValueError):
            P.duration(bad)


def test_default_range_includes_the_newest_point(spark):
    rows = [(NOW + timedelta(minutes=m),) for m in (0, 30, 61, 90)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    assert P.default_range(df).count() == 3
    assert P.default_range(df, now=NOW + timedelta(minutes=90)).count() == 2


def test_alignment_averages_repeated_times(spark):
    a = spark.createDataFrame([("h", NOW, 1.0), ("h", NOW, 3.0)], "host string, ts timestamp_ntz, v double")
    b = spark.createDataFrame([("h", NOW + timedelta(minutes=1), 5.0)], "host string, ts timestamp_ntz, v double")
    got = R.align([("x", a), ("y", b)], ["host", "ts"]).orderBy("ts").select("x_v", "y_v").collect()
    assert [tuple(r) for r in got] == [(2.0, None), (None, 5.0)]


def test_feature_policy(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double")
    assert [tuple(r) for r in R.feature_policy(df, ["a", "b", "c"]).orderBy("a").collect()] == [(1, 0, 0), (2, 3, 0)]
    assert R.feature_policy(df, ["a", "b"], "reject").count() == 1
    with pytest.raises(ValueError):
        R.feature_policy(df, ["c"], "reject")


def test_cpu_total_needs_user_time(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "usage_user double, usage_system double")
    assert sorted(r[0] for r in R.cpu_total(df).select("cpu_total").collect()) == [1, 3]
    with pytest.raises(ValueError):
        R.cpu_total(df.drop("usage_user"))


def test_exports(spark):
    rows = [("h", "m", datetime(2024, 1, 1) + timedelta(hours=i), float(10 + i % 7)) for i in range(72)]
    series = spark.createDataFrame(rows, "host string, metric string, ts timestamp_ntz, value double")
    risk = K.hour_risk(series)
    overall = K.overall_risk(risk, 1)
    csv, js = shared_dir(spark, "csv"), shared_dir(spark, "json")
    Z.export_csv(risk, now(), csv)
    back = spark.read.option("header", True).csv(csv)
    assert back.count() == 24 and "method_ewma" in back.columns
    Z.export_summary_json(overall, js, 7, threshold=0.0)
    row = spark.read.json(js).first()
    assert row["total_hours"] == 24 and len(row["high_risk_periods"]) == 24


def test_dashboard_boundaries(spark):
    at = datetime(2024, 1, 1)
    rows = [(i, at, "h", m, "used_percent", v) for i, (m, v) in enumerate([("cpu", 80.0), ("mem", 90.0), ("disk", 90.5)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, measurement string, field string, value double")
    row = A.dashboard_summary(df, ["ts", "event_id"]).first()
    assert (row["cpu_status"], row["mem_status"], row["disk_status"], row["health_score"]) == ("warning", "critical", "critical", 70)


def test_materialized_frame_is_read_back(spark):
    assert materialize(spark.range(5).toDF("x"), "test").count() == 5


def test_empty_input_gives_empty_tables(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp_ntz, host string, measurement string, field string, value double")
    tables = jobs.ensemble_job(empty)
    assert tables.risk.count() == 0 and tables.overall.count() == 0 and jobs.peak_job(empty).risk.count() == 0


def test_unreadable_times_are_rejected(spark):
    bodies = ['{"measurement":"cpu","fields":{"u":1},"timestamp":"yesterday"}', '{"measurement":"cpu","fields":{"u":1}}']
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "batch_id long, index long, json string")
    for strict in (True, False):
        got = G.ingest_metrics(df, now(), strict=strict)
        assert [(r["index"], r["reason"]) for r in got.rejects.collect()] == [(0, "unreadable time")]
        assert [r["ts"] for r in got.points.collect()] == [NOW]


def test_reports_are_scored_apart_whatever_their_keys(spark):
    df = spark.createDataFrame([(None, NOW, REPORT.replace(" 13\n", " 90\n")), ("sda", NOW, REPORT), ("sda", NOW, None)],
                               "device string, ts timestamp_ntz, report string")
    lines = sorted(r["line"].split("failure_probability=")[1].split(",")[0] for r in jobs.disk_failure_job(df, ["device", "ts"]).collect())
    assert lines == ["0.05", "0.13", "0.9"]


def test_dashboard_counts_every_disk(spark):
    rows = [(i, NOW, "h", "disk", "used_percent", v, {"device": d}) for i, (d, v) in enumerate([("sda", 10.0), ("sdb", 95.0)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, measurement string, field string, value double, tags map<string,string>")
    row = A.dashboard_metrics(df, ["ts", "event_id"]).first()
    assert (row["value"], row["status"]) == (52.5, "normal")


def test_tag_sets_of_different_tags_differ(spark):
    tags = [{"a": "1", "b": "2"}, {"b": "2", "a": "1"}, {"a": "1,b=2"}, {"a\\": "1"}, {}, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    got = [r["tag_set"] for r in R.with_tag_set(df).orderBy("i").collect()]
    assert got == ["a=1,b=2", "a=1,b=2", "a=1\\,b\\=2", "a\\\\=1", "", ""]


def test_silent_hosts_and_alert_rows(spark):
    rows = [("a", "cpu", NOW - timedelta(days=1), 95.0), ("b", "anomaly_rate", NOW - timedelta(seconds=30), 0.35), ("b", None, NOW, 1.0)]
    df = spark.createDataFrame(rows, "host string, metric string, ts timestamp_ntz, value double")
    got = L.down(df, ["host"], NOW, "2m").collect()
    assert [(r["host"], r["silent_seconds"]) for r in got] == [("a", 86400.0)]
    alerts = L.to_alerts(df.withColumns({"threshold": F.lit(0.3), "severity": F.lit("critical")}), ["host", "metric"]).collect()
    assert len({r["id"] for r in alerts}) == 3
    assert {r["message"] for r in alerts if r["metric"] == "anomaly_rate"} == {"anomaly_rate at 35.0% is beyond its limit of 30.0%"}


def test_default_range_reads_the_newest_days_only(spark, tmp_path):
    at = datetime(2024, 3, 2, 0, 20)
    rows = [(at - timedelta(minutes=m), float(m)) for m in (0, 10, 19, 30, 61, 3000)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, value double").withColumn("day", F.to_date("ts"))
    path = tmp_path / "points"
    table.write.partitionBy("day").parquet(str(path))
    # the values of a day that is not needed cannot even be read, only its footer
    (old,) = (path / "day=2024-02-28").glob("*.parquet")
    (old.parent / f".{old.name}.crc").unlink()
    whole = old.read_bytes()
    old.write_bytes(whole[:4] + bytes(len(whole[4:50])) + whole[50:])
    kind = "ts timestamp_ntz, value double, day date"
    stored = spark.read.schema(kind).parquet(str(path))
    with pytest.raises(Exception):
        stored.agg(F.max("ts")).collect()
    found = P.default_range(stored)
    assert sorted(r["value"] for r in found.collect()) == [0.0, 10.0, 19.0, 30.0]
    plain = P.default_range(table.drop("day"))
    assert sorted(r["value"] for r in plain.collect()) == [0.0, 10.0, 19.0, 30.0]
