"""Next-value forecaster: past rows of all features to the next value of the first one.

A linear model over the flattened window, fitted by MLlib over the sequences of
all hosts at once.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import windows as W
from pulsegrid.operators.scaling import Scaler


def flatten_windows(sequences: DataFrame, column: str = "window", name: str = "features") -> DataFrame:
    """``ARRAY<ARRAY<DOUBLE>>`` to one vector."""
    return sequences.withColumn(name, array_to_vector(F.flatten(column)))


def training_sequences(
    grid: DataFrame, scaler: Scaler, length: int, keys: list[str], bounded: bool = True
) -> DataFrame:
    """Scaled sequences with ``part`` (train, val, test) by time within each series."""
    sequences = W.sequence_windows(scaler.scale(grid), keys, list(scaler.features), length, bounded=bounded)
    return W.chrono_split(flatten_windows(sequences), keys, bounded=bounded)


def fit_sequence_model(
    sequences: DataFrame, reg: float = 0.01, elastic: float = 0.0, iterations: int = 50
) -> LinearRegressionModel:
    """Fit on ``features`` and ``target``."""
    learner = LinearRegression(
        featuresCol="features", labelCol="target", predictionCol="predicted",
        regParam=reg, elasticNetParam=elastic, maxIter=iterations, standardization=False,
    )
    return learner.fit(sequences.select("features", "target"))


def recent_windows(grid: DataFrame, features: list[str], length: int, keys: list[str]) -> DataFrame:
    """The newest ``length`` rows per series as one window, for series that have them.

    Adds ``ts`` of the newest row, ``current`` and ``mean`` of the first feature.
    """
    latest = W.tail_n(grid, length, keys)
    row = F.struct(F.col("ts"), F.array(*[F.col(f).cast("double") for f in features]).alias("row"))
    first = F.col(features[0]).cast("double")
    grouped = latest.groupBy(*keys).agg(
        F.array_sort(F.collect_list(row)).alias("_rows"),
        F.max("ts").alias("ts"),
        F.max_by(first, F.col("ts")).alias("current"),
        F.avg(first).alias("mean"),
    )
    return grouped.where(F.size("_rows") == length).select(
        *keys, "ts", "current", "mean", F.col("_rows.row").alias("window")
    )


def predict_next(model: LinearRegressionModel, scaler: Scaler, grid: DataFrame, length: int, keys: list[str]) -> DataFrame:
    """One prediction per series in original units: ``(keys, ts, current, mean, prediction)``."""
    features = list(scaler.features)
    windows = recent_windows(scaler.scale(grid), features, length, keys)
    scored = model.transform(flatten_windows(windows))
    first = features[0]
    return scored.select(
        *keys,
        "ts",
        scaler.unscale(F.col("current"), first).alias("current"),
        scaler.unscale(F.col("mean"), first).alias("mean"),
        scaler.unscale(F.col("predicted"), first).alias("prediction"),
    )
