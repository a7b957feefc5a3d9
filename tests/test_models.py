"""Models recover what was planted; streams agree with batch."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators import disk_model as DM
from pulsegrid.operators import seasonal as E
from pulsegrid.operators.iforest import fit_isolation_forest
from pulsegrid.operators.scaling import fit_scaler
from pulsegrid.operators.windows import hash_split
from pulsegrid.plans import jobs
from pulsegrid.plans import training as T
from pulsegrid.session import shared_dir
from pulsegrid.streaming import feeds
from pulsegrid.streaming.cycle import cycle_writer

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def grid(spark):
    """Two hosts, ten days of hours, a daily wave."""
    rng = np.random.default_rng(2)
    rows = []
    for host in ("a", "b"):
        for i in range(240):
            wave = 50 + 20 * np.sin(2 * np.pi * i / 24) + rng.normal(0, 1)
            rows.append((host, START + timedelta(hours=i), float(wave), float(rng.normal(40, 2))))
    return spark.createDataFrame(rows, "host string, ts timestamp_ntz, cpu double, mem double").cache()


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, k double")
    scaler = fit_scaler(df, ["x", "k"])
    assert scaler.scales == pytest.approx((np.std([1, 2, 4]), 1.0))
    back = scaler.scale(df).select(scaler.unscale(F.col("x"), "x")).collect()
    assert [r[0] for r in back] == pytest.approx([1, 2, 4])


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (2000, 2)))]
    rows += [(10_000 + i, 12.0 + i, -12.0 - i) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    model = fit_isolation_forest(df, ["x", "y"], ["id"], trees=50)
    scored = model.transform(df)
    worst = [r["id"] for r in scored.orderBy("score").limit(10).collect()]
    assert set(worst) == set(range(10_000, 10_010))
    share = scored.where("is_anomaly").count() / len(rows)
    assert 0.005 <= share <= 0.015
    again = fit_isolation_forest(df.repartition(7), ["x", "y"], ["id"], trees=50)
    assert again.threshold == pytest.approx(model.threshold) and again.offset == pytest.approx(model.offset)


def test_disk_model_separates_and_guards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(t), float(s), int(s > 60)) for i, (t, s) in enumerate(rng.uniform(0, 100, (1500, 2)))]
    df = hash_split(spark.createDataFrame(rows, "id long, t double, s double, failed int"), ["id"])
    model = DM.fit_disk_model(df.where("part = 'train'"), "failed", ["t", "s"], rounds=5)
    scored = DM.predict_disk(model, df.where("part = 'test'"), ["t", "s"])
    auc = A.roc_auc(scored.withColumnsRenamed({"failed": "label", "probability": "score"}), ["part"]).first()["auc"]
    assert auc > 0.95
    assert DM.fit_disk_model(df.withColumn("failed", F.lit(0)), "failed", ["t", "s"]) is None
    row = DM.predict_disk(None, df, ["t", "s"]).first()
    assert (row["probability"], row["status"]) == (0.05, "unknown")


def test_disk_model_on_bins_equals_trees_on_all_rows(spark):
    """Fitting reads one weighted row per combination of bins, and the trees are those of all rows."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 10, (3000, 3))
    x[:, 1] = np.round(x[:, 1])
    x[rng.random(3000) < 0.6, 2] = 0  # one value holds many shares
    y = x[:, 0] + x[:, 1] + rng.normal(0, 5, 3000) > 12
    names = ["a", "b", "c", "same"]
    rows = [(i, *map(float, r), 7.0, int(f)) for i, (r, f) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, same double, failed int")
    plain = Pipeline(stages=[
        VectorAssembler(inputCols=names, outputCol="features"),
        GBTClassifier(featuresCol="features", labelCol="failed", maxIter=5, stepSize=0.1, maxDepth=3, seed=42),
    ]).fit(df)
    want = {r["id"]: r["p"] for r in plain.transform(df).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    model = DM.fit_disk_model(df, "failed", names, rounds=5)
    got = {r["id"]: r["probability"] for r in DM.predict_disk(model, df, names).collect()}
    assert got == pytest.approx(want, abs=1e-9)
    # copies change nothing but the weights: every round still reads the same rows
    few = df.where("id < 300").select(*[F.round(n).alias(n) for n in names], "failed")
    copied = few.crossJoin(spark.range(40).select())
    seen = []
    real = DM.GBTClassifier.fit

    def fit(self, data, *more):
        seen.append((data.count(), data.agg(F.sum("weight")).first()[0]))
        return real(self, data, *more)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(DM.GBTClassifier, "fit", fit)
        one, many = (DM.fit_disk_model(d, "failed", names, rounds=2) for d in (few, copied))
    assert seen[0][0] == seen[1][0] and seen[0][1] == 300 and seen[1][1] == 12_000
    a, b = ({(r["a"], r["b"], r["c"]): r["probability"] for r in DM.predict_disk(m, few, names).collect()} for m in (one, many))
    assert a == pytest.approx(b, abs=1e-9)


def test_seasonal_model_recovers_a_wave(grid):
    series = grid.select("host", "ts", F.col("cpu").alias("value"))
    model = E.fit_seasonal(series, ["host"])
    ahead = E.seasonal_forecast(model, 24, 60).where("host = 'a'").orderBy("ts").collect()
    truth = [50 + 20 * np.sin(2 * np.pi * i / 24) for i in range(240, 264)]
    assert [r["yhat"] for r in ahead] == pytest.approx(truth, abs=3)
    assert all(r["yhat_lower"] < r["yhat"] < r["yhat_upper"] for r in ahead)


def test_training_storing_and_cycle(spark, grid):
    path = shared_dir(spark, "models-test")
    models, results, points = T.run_training(
        grid, ["cpu", "mem"], 24, seasonal_target="cpu", save_to=path, now=F.lit(str(START)).cast("timestamp_ntz")
    )
    values = {(r["model"], r["metric"]): r["value"] for r in results.collect()}
    assert values[("sequence", "mae")] < 0.3 and ("anomaly", "anomaly_rate") in values
    assert {r["field"] for r in points.collect()} >= {"sequence_mae", "anomaly_anomaly_rate"}
    loaded = T.load_models(spark, path)
    assert loaded.disk is None and loaded.length == 24 and loaded.scaler == models.scaler
    rules = L.rules_table(spark, [(None, "cpu_usage", "gt", 0.0, "warning", 5)])
    found = T.run_cycle(grid, loaded, rules=rules, horizon=48, step_minutes=60)
    assert {r["measurement"] for r in found.points.collect()} == {"prediction", "anomaly"}
    assert sorted(r["host"] for r in found.alerts.collect()) == ["a", "b"]
    last = {r["host"]: r["ts"] for r in grid.groupBy("host").agg(F.max("ts").alias("ts")).collect()}
    ahead = {(r["host"], r["ts"]): r for r in found.forecasts.collect()}
    assert set(ahead) == {(h, t + timedelta(hours=i)) for h, t in last.items() for i in range(1, 49)}
    assert all(r["lower_bound"] < r["prediction"] < r["upper_bound"] for r in ahead.values())
    assert loaded.seasonal_target == "cpu" and found.seasonal.table.count() == 2
    assert T.load_models(spark, f"{path}-missing") == T.Models()


def test_cycle_on_a_stream_repeats_without_duplicates(spark, grid):
    models, _, _ = T.run_training(grid.withColumnsRenamed({"cpu": "cpu_u", "mem": "mem_p"}), ["cpu_u", "mem_p"], 24)
    long = grid.unpivot(["host", "ts"], ["cpu", "mem"], "measurement", "value")
    points = long.withColumn("field", F.when(F.col("measurement") == "cpu", "u").otherwise("p"))
    feed_path, log = shared_dir(spark, "cycle-feed"), shared_dir(spark, "cycle-log")
    points.coalesce(1).write.parquet(feed_path)
    paths = [shared_dir(spark, f"cycle-{n}") for n in ("points", "results", "alerts")]
    body = cycle_writer(models, ["cpu_u", "mem_p"], *paths, history="40 hours", step="1 hour")
    feed = feeds.stream_points(spark, feed_path, points.schema)
    run = feeds.stream_cycle(feed, body, log, available_now=True)
    run.awaitTermination()
    first = spark.read.parquet(paths[1]).count()
    body(points, 0)
    assert first > 0 and spark.read.parquet(paths[1]).count() == first
    assert {r["host"] for r in spark.read.parquet(paths[1]).collect()} == {"a", "b"}


def _coefficients(model):
    return {r["host"]: (r["n"], r["origin"], r["last_ts"], r["coef"], r["sigma"]) for r in model.table.collect()}


def _close(a, b, tolerance=1e-7):
    assert set(a) == set(b)
    for host in a:
        assert a[host][:3] == b[host][:3]
        assert a[host][3] == pytest.approx(b[host][3], abs=tolerance) and a[host][4] == pytest.approx(b[host][4], abs=tolerance)


def test_merged_days_fit_like_all_rows(spark, grid):
    series = grid.select("host", "ts", F.col("cpu").alias("value"))
    whole = E.fit_seasonal(series, ["host"])
    # the plain least squares of all terms from a series' first row
    rows = series.where("host = 'a'").orderBy("ts").collect()
    days = np.array([(r["ts"] - rows[0]["ts"]) / timedelta(days=1) for r in rows])
    x, y = E.term_values(days, whole.seasons), np.log1p(np.maximum([r["value"] for r in rows], 0))
    penalty = np.full(x.shape[1], 1e-6)
    penalty[-20:] = 1e-2
    plain = np.linalg.solve(x.T @ x + len(x) * np.diag(penalty), x.T @ y)
    assert _coefficients(whole)["a"][3] == pytest.approx(plain, abs=1e-7)
    # cells of any length, and rows that come cycle by cycle, a series that starts late among them
    _close(_coefficients(E.fit_seasonal(series, ["host"], cell_micros=7 * 3_600_000_000)), _coefficients(whole))
    late = series.where(f"host = 'a' or ts >= TIMESTAMP_NTZ '{START + timedelta(days=3)}'")
    model = E.fit_seasonal(late.where(f"ts < TIMESTAMP_NTZ '{START + timedelta(days=2, hours=5)}'"), ["host"])
    assert set(_coefficients(model)) == {"a"}
    for hours in (60, 77, 77, 150, 240):  # the second 77 brings nothing
        model = E.update_seasonal(model, late.where(f"ts < TIMESTAMP_NTZ '{START + timedelta(hours=hours)}'"))
    _close(_coefficients(model), _coefficients(E.fit_seasonal(late, ["host"])))


def test_seasonal_update_of_nothing(spark, grid):
    series = grid.select("host", "ts", F.col("cpu").alias("value"))
    model = E.fit_seasonal(series, ["host"])
    empty = series.limit(0).unionByName(series.limit(1).withColumns({"ts": F.expr("ts + INTERVAL 900 DAY"), "value": F.lit(None).cast("double")}))
    _close(_coefficients(E.update_seasonal(model, empty)), _coefficients(model))
    assert E.seasonal_forecast(E.fit_seasonal(series.limit(0), ["host"]), 3).count() == 0


def test_streamed_cycles_keep_the_seasonal_model_up_to_date(spark, grid):
    named = grid.withColumnsRenamed({"cpu": "cpu_u", "mem": "mem_p"})
    early = named.where(f"ts < TIMESTAMP_NTZ '{START + timedelta(days=4)}'")
    models, _, _ = T.run_training(early, ["cpu_u", "mem_p"], 24, seasonal_target="cpu_u")
    long = grid.unpivot(["host", "ts"], ["cpu", "mem"], "measurement", "value")
    points = long.withColumn("field", F.when(F.col("measurement") == "cpu", "u").otherwise("p"))
    paths = [shared_dir(spark, f"seasonal-cycle-{n}") for n in ("points", "results", "alerts", "forecasts")]
    body = cycle_writer(models, ["cpu_u", "mem_p"], *paths[:3], history="40 hours", step="1 hour", forecasts_path=paths[3], horizon=5, step_minutes=60)
    cuts = [0, 100, 130, 131, 241]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        batch = points.where(f"ts >= TIMESTAMP_NTZ '{START + timedelta(hours=a)}' and ts < TIMESTAMP_NTZ '{START + timedelta(hours=b)}'")
        body(batch, i)
        if i == 1:
            body(batch, i)  # repeated after a failure
    known = grid.where(f"ts < TIMESTAMP_NTZ '{START + timedelta(hours=239)}'").select("host", "ts", F.col("cpu").alias("value"))
    sums = spark.read.parquet(f"{paths[3]}-sums").where("batch = 3").drop("batch")
    want = E.fit_seasonal(known, ["host"])
    _close(_coefficients(E.solve_seasonal(sums, ["host"], want.seasons, True)), _coefficients(want))
    ahead = spark.read.parquet(paths[3]).where("batch = 3")
    assert ahead.groupBy("host").count().collect()[0]["count"] == 5
    assert ahead.agg(F.min("ts")).first()[0] == START + timedelta(hours=239)


def test_disk_outlook_defaults_for_silent_devices(spark):
    devices = spark.createDataFrame([(1,), (2,)], "device long")
    smart = spark.createDataFrame([(1, START, 3.0)], "device long, ts timestamp_ntz, t double")
    out = {r["device"]: r for r in jobs.disk_outlook(devices, smart, None, ["t"], START + timedelta(minutes=5)).collect()}
    assert out[1]["smart_available"] and out[1]["active_attributes"] == ["t"]
    assert (out[2]["probability"], out[2]["status"], out[2]["smart_available"]) == (0.05, "unknown", False)


def test_stream_alerts_drop_a_second_delivery(spark):
    rows = [("h", "m", START + timedelta(seconds=i), 100.0) for i in range(5)]
    df = spark.createDataFrame(rows, "host string, metric string, ts timestamp_ntz, value double")
    path = shared_dir(spark, "feed")
    df.coalesce(1).write.parquet(path)
    df.coalesce(1).write.mode("append").parquet(path)
    feed = feeds.stream_points(spark, path, df.schema, max_files=1)
    rules = L.rules_table(spark, [(None, "m", "gt", 50.0, "warning", 5)])
    assert feeds.run_available(feeds.stream_alerts(feed, rules), "alerts-test").count() == 5


def test_late_rows_beyond_the_watermark_are_left_out(spark):
    path = shared_dir(spark, "late")
    columns = "host string, ts timestamp_ntz, value double"
    # Spark compares with the watermark of the batch before, so the late row comes third.
    for hour, value in ((5, 1.0), (6, 2.0), (0, 9.0), (9, 3.0)):
        row = [("h", START + timedelta(hours=hour), value)]
        spark.createDataFrame(row, columns).coalesce(1).write.mode("append").parquet(path)
    feed = feeds.stream_points(spark, path, spark.createDataFrame([], columns).schema, max_files=1)
    out = feeds.run_available(feeds.stream_aggregate_window(feed, ["host"], "1h"), "late-test")
    assert sorted(r["value"] for r in out.collect()) == [1.0, 2.0]


def test_a_series_does_not_change_the_forecast_of_another(spark, grid):
    series = grid.where("host = 'a'").select("host", "ts", F.col("cpu").alias("value"))
    days = F.explode(F.sequence(F.lit(0), F.lit(999))).alias("d")
    other = spark.range(1).select(F.lit("z").alias("host"), days).select(
        "host", (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(days="d")).alias("ts"), (F.col("d") % 7).cast("double").alias("value"))

    def ahead(df):
        return [r["yhat"] for r in E.seasonal_forecast(E.fit_seasonal(df, ["host"]), 5, 60).where("host = 'a'").orderBy("ts").collect()]

    assert ahead(series.unionByName(other)) == pytest.approx(ahead(series), rel=1e-9)


def test_sliding_deviation_of_large_values(spark):
    rows = [("h", START + timedelta(minutes=i), 1e12 + i) for i in range(9)]
    df = spark.createDataFrame(rows, "host string, ts timestamp_ntz, value double")
    got = {r["ts"]: r["std"] for r in feeds.sliding_stats(df, ["host"], "60 minutes", "1 minute", late=None).collect()}
    assert got[START] == pytest.approx(np.std(np.arange(9)), rel=1e-6)
