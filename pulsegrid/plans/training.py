"""Training run, stored models, evaluation and the prediction cycle."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from pulsegrid.operators import aggregate as A
from pulsegrid.operators import alerts as L
from pulsegrid.operators import sequence_model as Q
from pulsegrid.operators import windows as W
from pulsegrid.operators.disk_model import fit_disk_model, predict_disk
from pulsegrid.operators.iforest import IsolationForestModel, fit_isolation_forest
from pulsegrid.operators.ordered import union_all
from pulsegrid.operators.scaling import Scaler, fit_scaler
from pulsegrid.operators.seasonal import SeasonalModel, fit_seasonal, seasonal_forecast, update_seasonal
from pulsegrid.session import materialize
from pulsegrid.sources import sinks

RECENT_ROWS = 10


@dataclass(frozen=True)
class Models:
    """Any part may be missing; jobs skip what needs it."""

    scaler: Scaler | None = None
    sequence: LinearRegressionModel | None = None
    length: int = 60
    forest: IsolationForestModel | None = None
    disk: PipelineModel | None = None
    disk_threshold: float = 0.8
    seasonal: SeasonalModel | None = None
    seasonal_target: str | None = None


class Cycle(NamedTuple):
    """What a prediction cycle found; ``forecasts`` and the updated ``seasonal`` model are there if the models have one."""

    points: DataFrame
    alerts: DataFrame
    forecasts: DataFrame | None
    seasonal: SeasonalModel | None


def save_models(spark: SparkSession, models: Models, path: str) -> None:
    """One folder per part and a manifest of what is there."""
    parts = []
    if models.scaler is not None:
        models.scaler.to_table(spark).write.mode("overwrite").parquet(f"{path}/scaler")
        parts.append("scaler")
    if models.sequence is not None:
        models.sequence.write().overwrite().save(f"{path}/sequence")
        parts.append("sequence")
    if models.forest is not None:
        nodes, params = models.forest.to_tables(spark)
        nodes.write.mode("overwrite").parquet(f"{path}/forest_nodes")
        params.write.mode("overwrite").parquet(f"{path}/forest_params")
        parts.append("forest")
    if models.disk is not None:
        models.disk.write().overwrite().save(f"{path}/disk")
        parts.append("disk")
    if models.seasonal is not None:
        s = models.seasonal
        s.table.write.mode("overwrite").parquet(f"{path}/seasonal")
        s.sums.write.mode("overwrite").parquet(f"{path}/seasonal_sums")
        seasons = [list(map(float, p)) for p in s.seasons]
        row = [(list(s.keys), seasons, s.multiplicative, s.ridge, s.yearly_ridge, models.seasonal_target)]
        columns = (
            "keys array<string>, seasons array<array<double>>, multiplicative boolean, "
            "ridge double, yearly_ridge double, target string"
        )
        spark.createDataFrame(row, columns).write.mode("overwrite").parquet(f"{path}/seasonal_params")
        parts.append("seasonal")
    manifest = [(p, models.length, models.disk_threshold) for p in [*parts, "manifest"]]
    spark.createDataFrame(manifest, "part string, length int, disk_threshold double").write.mode(
        "overwrite"
    ).parquet(f"{path}/manifest")


def load_models(spark: SparkSession, path: str) -> Models:
    """What the manifest lists; nothing when there is none."""
    try:
        rows = spark.read.parquet(f"{path}/manifest").collect()  # one row per part
    except AnalysisException:
        return Models()
    parts = {r["part"] for r in rows}
    models = Models(length=rows[0]["length"], disk_threshold=rows[0]["disk_threshold"])
    if "scaler" in parts:
        models = replace(models, scaler=Scaler.from_table(spark.read.parquet(f"{path}/scaler")))
    if "sequence" in parts:
        models = replace(models, sequence=LinearRegressionModel.load(f"{path}/sequence"))
    if "forest" in parts:
        tables = [spark.read.parquet(f"{path}/forest_{t}") for t in ("nodes", "params")]
        models = replace(models, forest=IsolationForestModel.from_tables(*tables))
    if "disk" in parts:
        models = replace(models, disk=PipelineModel.load(f"{path}/disk"))
    if "seasonal" in parts:
        p = spark.read.parquet(f"{path}/seasonal_params").first()
        seasons = tuple((s[0], int(s[1])) for s in p["seasons"])
        tables = [spark.read.parquet(f"{path}/{name}") for name in ("seasonal", "seasonal_sums")]
        seasonal = SeasonalModel(
            tables[0], tuple(p["keys"]), seasons, p["multiplicative"], tables[1], p["ridge"], p["yearly_ridge"]
        )
        models = replace(models, seasonal=seasonal, seasonal_target=p["target"])
    return models


def evaluate(models: Models, test_sequences: DataFrame | None, test_rows: DataFrame | None) -> DataFrame:
    """Evaluation rows ``(model, metric, value)`` over the test part."""
    parts = []
    if models.sequence is not None and test_sequences is not None:
        predicted = models.sequence.transform(test_sequences)
        errors = A.regression_metrics(predicted, [], "target", "predicted")
        names = ["mae", "mse", "rmse", "mape", "r2"]
        parts.append(errors.unpivot([], names, "metric", "value").withColumn("model", F.lit("sequence")))
    if models.forest is not None and test_rows is not None:
        rate = A.anomaly_summary(models.forest.transform(test_rows), [])
        parts.append(rate.select(F.lit("anomaly_rate").alias("metric"), F.col("anomaly_rate").alias("value"),
                                 F.lit("anomaly").alias("model")))
    if not parts:
        raise ValueError("nothing to evaluate")
    return union_all(parts).select("model", "metric", "value")


def run_training(
    grid: DataFrame,
    features: list[str],
    length: int = 60,
    smart: DataFrame | None = None,
    smart_label: str = "failed",
    smart_features: list[str] | None = None,
    seasonal_target: str | None = None,
    save_to: str | None = None,
    now: Column | None = None,
) -> tuple[Models, DataFrame, DataFrame]:
    """Scale, sequence, split, fit, evaluate, store: models, evaluation rows and result points.

    ``grid`` is the aligned frame of all hosts (``jobs.aligned_frame``).  It is
    written to the shared folder once, as every fit reads it again.
    """
    spark = grid.sparkSession
    frame = materialize(grid.select("host", "ts", *features), "training-grid")
    scaler = fit_scaler(frame, features)
    sequences = materialize(Q.training_sequences(frame, scaler, length, ["host"]), "training-sequences")
    sequence = Q.fit_sequence_model(sequences.where("part = 'train'"))
    split = W.chrono_split(scaler.scale(frame), ["host"])
    train = split.where("part != 'test'")
    forest = fit_isolation_forest(train, features, ["host", "ts"])
    models = Models(scaler=scaler, sequence=sequence, length=length, forest=forest)
    if smart is not None:
        models = replace(models, disk=fit_disk_model(smart, smart_label, smart_features))
    if seasonal_target is not None:
        series = frame.select("host", "ts", F.col(seasonal_target).alias("value"))
        models = replace(models, seasonal=fit_seasonal(series, ["host"]), seasonal_target=seasonal_target)
    results = evaluate(models, sequences.where("part = 'test'"), split.where("part = 'test'"))
    if save_to is not None:
        save_models(spark, models, save_to)
    stamp = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    return models, results, sinks.results_to_points(results, stamp)


def run_cycle(
    grid: DataFrame, models: Models, smart: DataFrame | None = None, rules: DataFrame | None = None,
    smart_features: list[str] | None = None, horizon: int = 1440, step_minutes: int = 1,
    history: DataFrame | None = None,
) -> Cycle:
    """One prediction cycle for every host: prediction points, alerts and seasonal forecasts.

    Hosts with too few rows get no value for the parts that need more.  The seasonal model takes up the
    steps after its last ones from ``history`` (``grid`` if none is given) by adding their sums, then
    forecasts ``horizon`` steps as ``host, ts, prediction, lower_bound, upper_bound``.
    """
    spark = grid.sparkSession
    out = grid.groupBy("host").agg(F.max("ts").alias("ts"))
    if models.sequence is not None and models.scaler is not None:
        pred = Q.predict_next(models.sequence, models.scaler, grid, models.length, ["host"])
        out = out.join(pred.select("host", F.col("prediction").alias("cpu_prediction")), "host", "left")
    if models.forest is not None and models.scaler is not None:
        recent = W.tail_n(grid, RECENT_ROWS, ["host"])
        summary = A.anomaly_summary(models.forest.transform(models.scaler.scale(recent)), ["host"])
        enough = summary.where(F.col("total_points") >= RECENT_ROWS)
        out = out.join(enough.select("host", "anomaly_rate", "anomaly_count"), "host", "left")
        out = out.withColumn("anomaly_threshold", F.lit(models.forest.threshold))
    if models.disk is not None and smart is not None:
        scored = predict_disk(models.disk, smart, smart_features, models.disk_threshold, "reject")
        worst = A.disk_summary(scored, ["host"], models.disk_threshold)
        out = out.join(worst.select("host", F.col("max_probability").alias("disk_probability")), "host", "left")
        out = out.withColumn("disk_threshold", F.lit(models.disk_threshold))
    points = sinks.predictions_to_points(out)
    # Prediction column and the metric name its rule uses.
    names = [("cpu_prediction", "cpu_usage"), ("anomaly_rate", "anomaly_rate"), ("disk_probability", "disk_failure")]
    present = [(c, m) for c, m in names if c in out.columns]
    if not present:
        raise ValueError("no model to run")
    values = union_all(
        [out.select("host", "ts", F.lit(m).alias("metric"), F.col(c).alias("value")) for c, m in present]
    ).where(F.col("value").isNotNull())
    broken = L.evaluate_rules(values, rules if rules is not None else L.rules_table(spark))
    alerts = L.to_alerts(broken, ["host", "metric", "ts", "threshold"])
    if models.seasonal is None or models.seasonal_target is None:
        return Cycle(points, alerts, None, models.seasonal)
    steps = (grid if history is None else history).select("host", "ts", F.col(models.seasonal_target).alias("value"))
    seasonal = update_seasonal(models.seasonal, steps)
    names = {"yhat": "prediction", "yhat_lower": "lower_bound", "yhat_upper": "upper_bound"}
    ahead = seasonal_forecast(seasonal, horizon, step_minutes).withColumnsRenamed(names)
    return Cycle(points, alerts, ahead.select("host", "ts", *names.values()), seasonal)
