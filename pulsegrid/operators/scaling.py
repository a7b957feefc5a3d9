"""Feature standardisation with population deviations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and scale per feature; one feature list for fitting and use."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def scaled(self, feature: str) -> Column:
        i = self.features.index(feature)
        return (F.col(feature) - self.means[i]) / self.scales[i]

    def scale(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f: self.scaled(f) for f in self.features})

    def unscale(self, value: Column, feature: str) -> Column:
        i = self.features.index(feature)
        return value * self.scales[i] + self.means[i]

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, f, self.means[i], self.scales[i]) for i, f in enumerate(self.features)]
        return spark.createDataFrame(rows, "position int, feature string, mean double, scale double")

    @staticmethod
    def from_table(table: DataFrame) -> Scaler:
        rows = table.orderBy("position").collect()  # one row per feature
        return Scaler(
            tuple(r["feature"] for r in rows), tuple(r["mean"] for r in rows), tuple(r["scale"] for r in rows)
        )


def fit_scaler(df: DataFrame, features: list[str]) -> Scaler:
    """One aggregate pass; a feature without spread keeps scale 1."""
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(features)]
    aggs += [F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]
    row = df.agg(*aggs).first()
    means = tuple(0.0 if row[f"m{i}"] is None else float(row[f"m{i}"]) for i in range(len(features)))
    scales = tuple(float(row[f"s{i}"] or 1.0) for i in range(len(features)))
    return Scaler(tuple(features), means, scales)
