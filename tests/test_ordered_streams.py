"""Stream rules against plain code and the batch operators, for several cuts of the input into files."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as L
from pulsegrid.operators.transfer import Bucket
from pulsegrid.streaming import feeds
from pulsegrid.streaming import ordered_rules as O
from pulsegrid.streaming.quota import stream_token_bucket, token_bucket

START = dt.datetime(2024, 1, 1)
LATE = 600


def points(seed=4, count=600):
    """(event_id, host, seconds, value): quiet stretches, ties, and one host that stops."""
    rng, rows, clock = random.Random(seed), [], 0
    for i in range(count):
        clock += rng.choice([0, 5, 20, 60, 400, 900])
        host = rng.choice(["a", "b", "c"] if i < count // 2 else ["a", "b"])
        rows.append((i, host, clock, float(rng.choice([10, 50, 60, 70]))))
    return rows


def feed(spark, tmp_path, rows, cut, shuffled):
    """The rows as files of ``cut`` rows, one per batch; arrival shuffled within the lateness."""
    rng = random.Random(1)
    arrival = sorted(rows, key=lambda r: r[2] + (rng.random() * (LATE - 1) if shuffled else 0))
    for at in range(0, len(arrival), cut):
        part = [(i, h, START + dt.timedelta(seconds=s), v) for i, h, s, v in arrival[at : at + cut]]
        frame = spark.createDataFrame(part, "event_id long, host string, ts timestamp_ntz, value double")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    schema = spark.read.parquet(str(tmp_path / "feed")).schema
    return feeds.stream_points(spark, str(tmp_path / "feed"), schema, max_files=1)


def seconds(value):
    return int((value.replace(tzinfo=None) - START).total_seconds())


CUTS = [(600, False), (150, False), (120, True)]


@pytest.mark.parametrize("cut,shuffled", CUTS)
def test_sustained(spark, tmp_path, cut, shuffled):
    rows = points()
    passed = max(r[2] for r in rows) - LATE
    want = set()
    for host in "abc":
        run = None
        for i, _, s, v in sorted((r for r in rows if r[1] == host and r[2] < passed), key=lambda r: (r[2], str(r[0]))):
            if v <= 40:
                run = None
                continue
            start, n, top, told = run or (s, 0, v, False)
            n, top = n + 1, max(top, v)
            if not told and s - start >= 300:
                want.add((host, start, s, n, top))
                told = True
            run = (start, n, top, told)
    out = O.stream_sustained(feed(spark, tmp_path, rows, cut, shuffled), ["host"], F.col("value") > 40, "300s")
    got = {(r["host"], seconds(r["run_start"]), seconds(r["raised_at"]), r["points"], r["max_value"])
           for r in feeds.run_available(out, "t-sustained").collect()}
    assert got == want and want


@pytest.mark.parametrize("cut,shuffled", CUTS)
def test_downtime_equals_gaps_and_lasting_silence(spark, tmp_path, cut, shuffled):
    rows = points()
    passed = max(r[2] for r in rows) - LATE
    batch = spark.createDataFrame([(i, h, START + dt.timedelta(seconds=s)) for i, h, s, _ in rows], "event_id long, host string, ts timestamp_ntz")
    want = {(r["host"], seconds(r["gap_start"])) for r in L.gaps(batch, ["host"], ["ts", "event_id"], "1000s").collect()}
    now = START + dt.timedelta(seconds=max(r[2] for r in rows) + 1)
    want |= {(r["host"], seconds(r["last_seen"])) for r in L.down(batch, ["host"], str(now), "1000s").collect()}
    want = {(h, s) for h, s in want if s + 1000 < passed}
    out = O.stream_downtime(feed(spark, tmp_path, rows, cut, shuffled), ["host"], "1000s")
    found = feeds.run_available(out, "t-downtime").collect()
    assert all(seconds(r["down_at"]) - seconds(r["last_seen"]) == 1000 for r in found)
    got = [(r["host"], seconds(r["last_seen"])) for r in found]
    assert sorted(got) == sorted(want) and any(h == "c" for h, _ in got)


@pytest.mark.parametrize("cut,shuffled", CUTS)
def test_cooldown_equals_batch(spark, tmp_path, cut, shuffled):
    rows = points()
    passed = max(r[2] for r in rows) - LATE
    batch = spark.createDataFrame([(i, h, START + dt.timedelta(seconds=s), v, f"{i}") for i, h, s, v in rows],
                                  "event_id long, host string, ts timestamp_ntz, value double, tie string")
    want = L.cooldown(batch, ["host"], 700, tie="tie").select("event_id", "host", "ts", "value").collect()
    out = O.stream_cooldown(feed(spark, tmp_path, rows, cut, shuffled), ["host"], "700s", "event_id")
    got = feeds.run_available(out, "t-cooldown").collect()
    assert sorted((r["event_id"], r["host"], seconds(r["ts"]), r["value"]) for r in got) == sorted(
        (r["event_id"], r["host"], seconds(r["ts"]), r["value"]) for r in want if seconds(r["ts"]) < passed)


@pytest.mark.parametrize("cut,shuffled", CUTS)
def test_quota_equals_batch(spark, tmp_path, cut, shuffled):
    rows = points()
    passed = max(r[2] for r in rows) - LATE
    batch = spark.createDataFrame([(i, h, START + dt.timedelta(seconds=s)) for i, h, s, _ in rows], "event_id long, host string, ts timestamp_ntz")
    want = [(r["host"], seconds(r["ts"]), r["allowed"], r["retry_after"]) for r in token_bucket(batch, "host", ["ts", "event_id"], 2, 1 / 300).collect()]
    out = stream_token_bucket(feed(spark, tmp_path, rows, cut, shuffled), "host", 2, 1 / 300)
    got = [(r["host"], seconds(r["ts"]), r["allowed"], r["retry_after"]) for r in feeds.run_available(out, "t-quota").collect()]
    assert sorted(got) == sorted(r for r in want if r[1] < passed) and {r[2] for r in got} == {True, False}


@pytest.mark.parametrize("cut,shuffled", CUTS)
def test_quota_of_a_feed_that_ended_answers_every_request(spark, tmp_path, cut, shuffled):
    rows = points()
    batch = spark.createDataFrame([(i, h, START + dt.timedelta(seconds=s)) for i, h, s, _ in rows], "event_id long, host string, ts timestamp_ntz")
    want = [(r["host"], seconds(r["ts"]), r["allowed"], r["retry_after"]) for r in token_bucket(batch, "host", ["ts", "event_id"], 2, 1 / 300).collect()]
    source = feed(spark, tmp_path, rows, cut, shuffled).select("host", "ts")
    out = feeds.run_to_end(source, lambda r: stream_token_bucket(r, "host", 2, 1 / 300), "t-quota-end")
    got = [(r["host"], seconds(r["ts"]), r["allowed"], r["retry_after"]) for r in out.collect()]
    assert len(got) == len(rows) and sorted(got) == sorted(want)


def test_decide_all_is_decide_one_by_one():
    rng = random.Random(7)
    for capacity, rate, gaps in [(2, 1 / 2000, [0, 0, 1, 300, 9_000]), (20, 2.0, [0, 0, 0, 1, 30]), (1, 1 / 3, [0, 1, 2, 3, 4]), (3, 0.1, [50])]:
        bucket, at = Bucket.of(capacity, rate), [1_700_000_000_000_000]
        for _ in range(3000):
            at.append(at[-1] + rng.choice(gaps) * 1_000_000 + rng.choice([0, 1]))
        level, since, want = bucket.token // 3, at[0] - 5, []
        for t in at:
            ok, wait, level = bucket.decide(min(bucket.capacity, level + bucket.gained(t - since)))
            since = t
            want.append((ok, wait))
        allowed, wait, last = bucket.decide_all(bucket.token // 3, at[0] - 5, np.array(at))
        assert list(zip(allowed.tolist(), wait.tolist())) == want and last == level


def test_quota_holds_few_bytes_a_request(spark, tmp_path):
    count = 100_000
    at = (F.lit(START).cast("timestamp") + F.make_dt_interval(secs=F.col("id") * 0.7 + F.col("id") % 7 / 1000)).cast("timestamp_ntz")
    spark.range(count).select(F.lit("a").alias("host"), at.alias("ts")).coalesce(1).write.parquet(str(tmp_path / "busy"))
    schema = spark.read.parquet(str(tmp_path / "busy")).schema
    out = stream_token_bucket(feeds.stream_points(spark, str(tmp_path / "busy"), schema), "host", 2, 1 / 300)
    writer = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out"))
    run = writer.trigger(availableNow=True).start()
    run.awaitTermination()
    held = max(p.stateOperators[0].memoryUsedBytes for p in run.recentProgress if p.stateOperators)
    assert held < 8 * count
    batch = spark.read.parquet(str(tmp_path / "busy"))
    passed = batch.agg(F.max("ts")).first()[0] - dt.timedelta(seconds=LATE)
    want = token_bucket(batch, "host", ["ts"], 2, 1 / 300).where(F.col("ts") < F.lit(passed)).withColumn("ts", F.col("ts").cast("timestamp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() > 0.9 * count
    assert got.exceptAll(want.select(*got.columns)).isEmpty()
