"""Cell-wise order operators equal plain windows, also for one crowded series."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators import ordered
from pulsegrid.operators import reshape as R
from pulsegrid.operators import windows as W
from pulsegrid.operators.transfer import Bucket, chunk_map
from pulsegrid.streaming.quota import check, token_bucket

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def crowded(spark):
    """Series ``a`` holds most rows, many at equal times; a null key is a series too."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        key = "a" if i % 3 else ("b" if i % 2 else None)
        at = START + timedelta(seconds=int(rng.integers(0, 6 * 3600) // 5 * 5))
        rows.append((key, at, i, float(rng.integers(-50, 50)) / 4))
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, value double").repartition(5).cache()


@pytest.fixture(scope="module")
def frame(crowded):
    return crowded.toPandas().sort_values(["ts", "id"])


def groups(frame):
    return frame.groupby("k", dropna=False)


def by_id(df, column):
    return {r["id"]: r[column] for r in df.select("id", column).collect()}


@pytest.mark.parametrize("seconds", [7, 600, 86_400])
def test_series_index(crowded, frame, seconds):
    want = dict(zip(frame["id"], groups(frame).cumcount()))
    assert by_id(ordered.series_index(crowded, ["k"], ["ts", "id"], seconds), "rn") == want


def test_previous_row_and_running_total(crowded, frame):
    chained = ordered.previous_row(crowded, ["k"], ["ts", "id"], ["value"], 60)
    previous = groups(frame)["value"].shift(1)
    want = {i: (None if pd.isna(v) else v) for i, v in zip(frame["id"], previous)}
    assert by_id(chained, "prev_value") == want
    total = ordered.running_total(crowded, ["k"], ["ts", "id"], "value", "total", 60)
    sums = dict(zip(frame["id"], groups(frame)["value"].cumsum()))
    assert by_id(total, "total") == pytest.approx(sums)


def test_moving_stats_over_blocks(crowded, frame):
    out = W.moving_stats(crowded, 7, ["k"], ["ts", "id"], bounded=False, block_rows=10)
    assert out.count() == len(frame)
    mean = groups(frame)["value"].transform(lambda s: s.shift(1).rolling(7, min_periods=1).mean())
    got = by_id(out, "ma_mean")
    for i, v in zip(frame["id"], mean):
        assert got[i] is None if pd.isna(v) else got[i] == pytest.approx(v)


def test_frames_longer_than_a_block_are_refused(crowded):
    with pytest.raises(ValueError):
        W.moving_stats(crowded, 11, ["k"], ["ts", "id"], bounded=False, block_rows=10)


def test_sequences_over_blocks(crowded):
    plain = W.sequence_windows(crowded, ["k"], ["value"], 5, ["ts", "id"])
    blocks = W.sequence_windows(crowded, ["k"], ["value"], 5, ["ts", "id"], bounded=False, block_rows=8)
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, blocks.collect()))


def test_top_n_with_and_without_salts(crowded, frame):
    want = set(groups(frame).tail(9)["id"])
    for salts in (1, 4):
        got = W.tail_n(crowded, 9, ["k"], ["ts", "id"], salts)
        assert {r["id"] for r in got.collect()} == want


def test_exact_quantiles(spark, crowded, frame):
    out = ordered.exact_quantiles(crowded, ["k"], "value", {"q1": 0.25, "mid": 0.5, "top": 1.0})
    got = {r["k"]: (r["n"], r["q1"], r["mid"], r["top"]) for r in out.collect()}
    for key, part in groups(frame):
        want = (len(part), *np.percentile(part["value"], [25, 50, 100]))
        assert got[None if pd.isna(key) else key] == pytest.approx(want)
    odd = spark.createDataFrame([("x", v) for v in (1e12, -3.0, 0.0, 1e-9, float("nan"), None)], "k string, value double")
    row = ordered.exact_quantiles(odd, ["k"], "value", {"q": 0.25}).first()
    assert (row["n"], row["q"]) == (4, pytest.approx(np.percentile([1e12, -3, 0, 1e-9], 25)))


def test_quantiles_and_auc_of_values_that_lie_close_together(spark):
    rng = np.random.default_rng(8)
    values = np.sort(1e12 * (1 + rng.random(30_000) * 1e-4)).tolist() + [-1e12 - i / 8 for i in range(5000)] + [5e-324, -5e-324, 0.0, float("inf"), -1e308]
    table = spark.createDataFrame([("x", v, int(i % 7 == 0)) for i, v in enumerate(values)], "k string, value double, label int")
    placed = table.withColumns({"b": ordered.value_bucket(F.col("value")), "p": ordered.value_part(F.col("value"))})
    assert placed.groupBy("b").count().agg(F.max("count")).first()[0] > 4000
    # a part is 232 wide here
    assert placed.where("value > 0").groupBy("b", "p").count().agg(F.max("count")).first()[0] < 20
    assert placed.where("value < 0").groupBy("b", "p").count().agg(F.max("count")).first()[0] <= 8 * 233
    ranks = [r["value"] for r in placed.orderBy("b", "p", "value").collect()]
    assert ranks == sorted(values)
    finite = table.where("value < 1e13 and value > -1e13")
    probs = {"q1": 0.25, "mid": 0.5, "late": 0.999}
    got = ordered.exact_quantiles(finite, ["k"], "value", probs).first()
    kept = [v for v in values if abs(v) < 1e13]
    assert got["n"] == len(kept) and [got[q] for q in probs] == pytest.approx(np.quantile(kept, list(probs.values())).tolist(), rel=1e-15)
    pos, neg = ([v for i, v in enumerate(values) if (i % 7 == 0) == side] for side in (True, False))
    wins = np.searchsorted(np.sort(neg), pos).sum() + (np.searchsorted(np.sort(neg), pos, "right") - np.searchsorted(np.sort(neg), pos)).sum() / 2
    auc = A.roc_auc(table, ["k"], "label", "value").first()
    assert auc["auc"] == pytest.approx(wins / len(pos) / len(neg), rel=1e-12)


def test_salted_lookup_keeps_every_row(crowded):
    stats = crowded.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = ordered.salted_lookup(crowded, stats, ["k"], ["id"], 8)
    assert joined.count() == 3000 and joined.where("n is null").count() == 0


def test_densest_cell(crowded, frame):
    hour = frame["ts"].dt.floor("h")
    assert ordered.densest_cell(crowded, ["k"], "ts") == frame.groupby(["k", hour], dropna=False).size().max()


def test_repartitioning_changes_nothing(crowded):
    a = A.trend(crowded, ["k"], ["ts", "id"], bounded=False)
    b = A.trend(crowded.repartition(3), ["k"], ["ts", "id"], bounded=False)
    columns = ["k", "n", "trend"]
    assert sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


def greedy(times, seconds):
    out, last = [], None
    for t in times:
        if last is None or (t - last).total_seconds() >= seconds:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("seconds, chunk", [(300, 300), (300, 1000), (7, 86_400), (5000, 7200)])
def test_cooldown_equals_the_greedy_rule(crowded, frame, seconds, chunk):
    rows = crowded.where("k is not null")
    out = L.cooldown(rows, ["k"], seconds, chunk_seconds=chunk)
    for key, part in frame[frame["k"].notna()].groupby("k"):
        want = greedy(list(part["ts"]), seconds)
        got = sorted(r["ts"] for r in out.where(F.col("k") == key).collect())
        assert got == want


def test_cooldown_keeps_the_smallest_id_at_equal_times(spark):
    rows = spark.createDataFrame([("a", START, 2), ("a", START, 1)], "k string, ts timestamp_ntz, id long")
    assert [r["id"] for r in L.cooldown(rows, ["k"]).collect()] == [1]


def test_token_bucket_golden(spark):
    state = (None, 0.0)
    answers = []
    for _ in range(21):
        ok, wait, *state = check(0.0, state[0], state[1], 20, 2.0)
        answers.append((ok, wait))
    assert answers == [(True, 0)] * 20 + [(False, 1)]
    assert check(0.5, *state, 20, 2.0)[0]


def test_token_bucket_over_stretches(spark, crowded, frame):
    rows = crowded.where("k is not null")
    out = by_id(token_bucket(rows, "k", ["ts", "id"], 2, 0.1), "allowed")
    for _, part in frame[frame["k"].notna()].groupby("k"):
        tokens, last = None, 0.0
        for i, at in zip(part["id"], part["ts"]):
            ok, _, tokens, last = check(at.timestamp(), tokens, last, 2, 0.1)
            assert out[i] == ok


@pytest.mark.parametrize("seed", range(25))
def test_transfer_maps_equal_the_rule_for_every_start(seed):
    rng = random.Random(seed)
    bucket = Bucket.of(rng.choice((1, 2, 3, 20)), rng.choice((1 / 2000, 0.3, 2.0, 7.5)))
    pause = bucket.token // bucket.refill
    times = np.cumsum([rng.choice((0, 1, pause // 3, pause, pause + 1, rng.randint(0, 3 * pause))) for _ in range(rng.randint(1, 80))])
    if seed % 3 == 0:
        times = np.cumsum([rng.randint(0, pause) for _ in range(200)])
    starts = [0, 1, bucket.token - 1, bucket.token, bucket.capacity - 1, bucket.capacity] + [rng.randint(0, bucket.capacity) for _ in range(60)]

    def end(level, part):
        for i, at in enumerate(part):
            level = bucket.decide(min(bucket.capacity, level + (bucket.gained(at - part[i - 1]) if i else 0)))[2]
        return level

    whole, cut = chunk_map(bucket, times), rng.randint(0, len(times))
    assert [whole(x) for x in starts] == [end(x, times.tolist()) for x in starts]
    if 0 < cut < len(times):
        parts = chunk_map(bucket, times[:cut]).refilled(bucket.gained(int(times[cut] - times[cut - 1]))).then(chunk_map(bucket, times[cut:]))
        assert [parts(x) for x in starts] == [whole(x) for x in starts]
        assert np.array_equal(parts.start, whole.start) and np.array_equal(parts.level, whole.level)


def test_pieces_of_a_busy_client_stay_few():
    rng = random.Random(1)
    bucket = Bucket.of(20, 2.0)
    for most in (300_000, 600_000, 900_000, 1_000_000, 1_100_000):  # from three times the rate to just below it
        found = chunk_map(bucket, np.cumsum([rng.randint(0, most) for _ in range(4096)]))
        assert len(found.start) <= 4096, (most, len(found.start))
    assert len(chunk_map(bucket, np.cumsum([rng.randint(0, 300_000) for _ in range(4096)])).start) <= 60


def test_a_client_that_never_pauses_is_spread(spark):
    rng = random.Random(2)
    rows, at = [], START
    for i in range(9000):
        at += timedelta(milliseconds=rng.randint(0, 700))
        rows.append((1, "busy", at))
    rows += [(1, f"c{i % 50}", START + timedelta(seconds=rng.randint(0, 7200))) for i in range(1000)]
    rows = [(i, c, t) for i, (_, c, t) in enumerate(rows)] + [(10_000, "busy", None)]
    log = spark.createDataFrame(rows, "id long, client string, ts timestamp_ntz").repartition(6)
    cells = ordered.with_counted_cells(log, ["client"], "ts", 500).groupBy("_key", "_cell").count().collect()
    assert max(r["count"] for r in cells) <= 500 + 20 and sum(r["count"] for r in cells) == len(rows)
    for chunk in (500, 100_000):
        out = {r["id"]: (r["allowed"], r["retry_after"]) for r in token_bucket(log, "client", ["ts", "id"], 20, 2.0, chunk).collect()}
        assert out.pop(10_000) == (None, None) and len(out) == 10_000
        bucket = Bucket.of(20, 2.0)
        for client in {c for _, c, _ in rows}:
            level, since = bucket.capacity, None
            for i, t in sorted(((i, t) for i, c, t in rows if c == client and t), key=lambda x: (x[1], x[0])):
                now = (t - START) // timedelta(microseconds=1)
                level = min(bucket.capacity, level + (0 if since is None else bucket.gained(now - since)))
                ok, wait, level = bucket.decide(level)
                since = now
                assert out[i] == (ok, wait)


@pytest.mark.parametrize("rows", [7, 40, 10_000])
def test_counted_cells_serve_the_cell_operators(crowded, frame, rows):
    celled = ordered.with_counted_cells(crowded, ["k"], "ts", rows)
    fullest = celled.groupBy("_key", "_cell").count().agg(F.max("count")).first()[0]
    assert fullest < rows + 12 or rows == 10_000  # at most a dozen rows share a second here
    want = {i: n for _, part in groups(frame) for n, i in enumerate(part["id"])}
    assert by_id(ordered.series_index(celled, ["k"], ["ts", "id"]), "rn") == want
    got = by_id(ordered.running_total(celled, ["k"], ["ts", "id"], "value", "total"), "total")
    for _, part in groups(frame):
        assert [got[i] for i in part["id"]] == pytest.approx(part["value"].cumsum().tolist())


def test_sustained_and_gaps(spark):
    at = [0, 60, 120, 480, 540, 600, 900]
    values = [95, 96, 10, 95, 95, 97, 99]
    rows = [("h", START + timedelta(seconds=s), i, float(v)) for i, (s, v) in enumerate(zip(at, values))]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long, value double")
    runs = L.sustained(df, ["k"], ["ts", "id"], F.col("value") > 90, "5 minutes", 60).collect()
    assert [(r["points"], r["max_value"]) for r in runs] == [(4, 99.0)]
    silent = L.gaps(df, ["k"], ["ts", "id"], "2m", 60).orderBy("gap_start").collect()
    assert [r["gap_seconds"] for r in silent] == [360, 300]


def test_fills_are_idempotent_and_cover_edges(spark):
    rows = [("h", START + timedelta(hours=i), v) for i, v in enumerate([None, 1.0, None, 2.0, None])]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, value double")
    once = W.ffill_bfill(df, ["host"], ["value"])
    assert [r["value"] for r in once.orderBy("ts").collect()] == [1, 1, 1, 2, 2]
    twice = W.ffill_bfill(once, ["host"], ["value"])
    assert sorted(once.collect()) == sorted(twice.collect())


@pytest.mark.parametrize("seconds", [20, 300, 100_000])
def test_sustained_equals_plain_code_for_any_cell(spark, seconds):
    rng = random.Random(seconds)
    rows, clock = [], 0
    for i in range(500):
        clock += rng.choice([0, 3, 10, 40])
        rows.append((i, rng.choice(["a", None]), START + timedelta(seconds=clock), rng.choice([1.0, 9.0, 9.0, 9.0, None])))
    want = set()
    for key in ("a", None):
        run = []
        for i, _, t, v in [r for r in rows if r[1] == key] + [(None, key, None, None)]:
            if v == 9.0:
                run.append(t)
                continue
            if run and (run[-1] - run[0]).total_seconds() >= 60:
                want.add((key, run[0], run[-1], len(run), 9.0))
            run = []
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, value double")
    got = L.sustained(df, ["k"], ["ts", "id"], F.col("value") > 5, "60s", seconds).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 5


@pytest.mark.parametrize("seconds", [60, 700, 86_400])
def test_fill_equals_plain_window_for_any_cell(spark, seconds):
    rng = random.Random(seconds)
    rows = [(k, START + timedelta(minutes=m), rng.choice([None, None, None, float(m)]) if k != "empty" else None)
            for k in ("a", None, "empty") for m in range(90)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = {(r["k"], r["ts"]): r["value"] for r in W.ffill_bfill(df, ["k"], ["value"], seconds=seconds).collect()}
    for k in ("a", None, "empty"):
        mine = [r for r in rows if r[0] == k]
        last = next((v for _, _, v in mine if v is not None), None)
        for _, t, v in mine:
            last = v if v is not None else last
            assert got[k, t] == last


@pytest.mark.parametrize("stretch", [1, 7, 10_000])
def test_spine_in_stretches(spark, stretch):
    minutes = [0, 3, 4, 29]
    rows = [("a", START + timedelta(minutes=m), float(m)) for m in minutes] + [("b", START, 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    got = R.regularize(df, ["k"], "1 minute", stretch=stretch).collect()
    want = {("a", START + timedelta(minutes=m), float(m) if m in minutes else None) for m in range(30)} | {("b", START, 1.0)}
    assert len(got) == 31 and {tuple(r) for r in got} == want


def test_broadcast_only_within_rows_and_bytes(spark):
    small = spark.range(10).selectExpr("id", "repeat('x', 100) AS text")

    def hinted(**bounds):
        return "broadcast" in ordered.checked_broadcast(small, **bounds)._jdf.queryExecution().logical().toString()

    assert hinted() and not hinted(max_rows=9) and not hinted(max_bytes=900)
