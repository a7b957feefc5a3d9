"""Disk-failure classifier over SMART features.

Boosted trees tell rows apart only by the bins of their features.  So the thresholds of the
bins are found by counting the values of all rows, rows of the same bins and label become
one row with their number as its weight, and the trees are fitted on those.  There are at
most as many as combinations of bins, however long the table is, and every round reads them
instead of the table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators.ordered import value_bucket, value_part
from pulsegrid.operators.reshape import feature_policy
from pulsegrid.session import held

# Bins of a feature, MLlib's default.
BINS = 32


def _bin(name: str) -> str:
    return f"_bin_{name}"


def _ranked_values(rows: DataFrame, names: list[str]) -> DataFrame:
    """``(feature, value, n, at, before)``: every distinct value with its rows, its position and the rows below it.

    Values are counted per (feature, bucket, part); the counts of buckets and parts are summed up first,
    so only the values of one part are ordered together.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(names)]))
    value = F.col("value")
    counted = (
        rows.select(pairs.alias("_p")).select("_p.*").where(~F.isnan(value))
        .groupBy("feature", value_bucket(value).alias("bucket"), value_part(value).alias("part"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )

    def below(column: str, keys: list[str], by: str) -> Column:
        frame = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    bucket, part = ["feature", "bucket"], ["feature", "bucket", "part"]
    parts = counted.groupBy(*part).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"))
    buckets = parts.groupBy(*bucket).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    buckets = buckets.select(*bucket, below("n", ["feature"], "bucket").alias("_n"), below("d", ["feature"], "bucket").alias("_d"))
    parts = parts.join(buckets, bucket).select(
        *part, (F.col("_n") + below("n", bucket, "part")).alias("_n"), (F.col("_d") + below("d", bucket, "part")).alias("_d")
    )
    place = F.row_number().over(Window.partitionBy(*part).orderBy("value"))
    return counted.join(parts, part).select(
        "feature", "value", "n", (F.col("_d") + place - 1).alias("at"), (F.col("_n") + below("n", part, "value")).alias("before")
    )


def bin_thresholds(rows: DataFrame, names: list[str], bins: int = BINS) -> list[list[float]]:
    """Per feature the thresholds MLlib chooses for its bins, from the values of all rows.

    With few distinct values those halfway between any two; else the n-th lies before the first value, after the
    threshold before it, that brings the rows up to it nearer to n shares of all rows than leaving it out.
    """
    out: list[list[float]] = [[] for _ in names]
    with held(_ranked_values(rows, names), "feature-values") as ranked:
        sizes = ranked.groupBy("feature").agg(F.max("at").alias("last"), F.sum("n").alias("rows"))
        middle = F.col("before") + F.col("n") / 2
        share = F.col("rows") / F.least(F.col("rows"), F.lit(bins))
        nearer = [F.min(F.when((F.col("at") > 0) & (middle > k * share), F.col("at"))).alias(f"k{k}") for k in range(1, bins)]
        of_feature = ranked.join(F.broadcast(sizes), "feature").groupBy("feature", "last", "rows").agg(*nearer)
        wanted = {}
        for r in of_feature.collect():  # one row per feature
            most = min(bins, r["rows"])
            if r["last"] < most:
                places = list(range(1, r["last"] + 1))
            else:
                places = []
                for k in range(1, most):
                    at = r[f"k{k}"]
                    at = None if at is None else max(at, places[-1] + 1 if places else 1)
                    if at is None or at > r["last"]:
                        break
                    places.append(at)
            wanted[r["feature"]] = places
        asked = [(F.col("feature") == f) & F.col("at").isin([*p, *(i - 1 for i in p)]) for f, p in wanted.items() if p]
        if asked:
            found = ranked.where(reduce(lambda a, b: a | b, asked)).select("feature", "at", "value").collect()  # two per threshold
            value = {(r["feature"], r["at"]): r["value"] for r in found}
            for f, places in wanted.items():
                out[f] = [(value[f, i - 1] + value[f, i]) / 2 for i in places]
    return out


def _bucketizer(names: list[str], thresholds: list[list[float]]) -> Bucketizer:
    """Numbers the bins; a value equal to a threshold lies below it, as in a tree."""
    edges = []
    for cuts in thresholds:
        above = sorted({math.nextafter(c, math.inf) for c in cuts if math.isfinite(c)})
        edges.append([-math.inf, *(above or [0.0]), math.inf])  # Bucketizer wants an edge; one for a constant feature decides nothing
    return Bucketizer(splitsArray=edges, inputCols=names, outputCols=[_bin(n) for n in names])


def fit_disk_model(
    df: DataFrame,
    label: str,
    features: list[str] | None = None,
    rounds: int = 100,
    rate: float = 0.1,
    depth: int = 3,
    seed: int = 42,
) -> PipelineModel | None:
    """Boosted trees; None when no row is labelled as failed."""
    names = features or schema.SMART_FEATURES
    rows = feature_policy(df, names, "reject").select(*names, F.col(label).cast("double").alias("label"))
    binned = [_bin(n) for n in names]
    with held(rows, "disk-rows") as rows:
        if rows.where(F.col("label") == 1).isEmpty():
            return None
        bucketizer = _bucketizer(names, bin_thresholds(rows, names))
        # without Bucketizer's metadata, by which trees would take the numbers for names
        numbered = bucketizer.transform(rows).select(*[F.col(b).alias(b, metadata={}) for b in binned], "label")
        grouped = numbered.groupBy(*binned, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        with held(grouped, "disk-bins") as groups:
            # the bins are the values now; MLlib looks at all rows for them if their number is at most maxBins squared
            most = max(BINS, math.isqrt(groups.count()) + 1)
            stages = [
                VectorAssembler(inputCols=binned, outputCol="features"),
                GBTClassifier(
                    featuresCol="features", labelCol="label", weightCol="weight", maxIter=rounds, stepSize=rate,
                    maxDepth=depth, maxBins=most, seed=seed,
                ),
            ]
            fitted = Pipeline(stages=stages).fit(groups)
    return PipelineModel([bucketizer, *fitted.stages])


def predict_disk(
    model: PipelineModel | None,
    df: DataFrame,
    features: list[str] | None = None,
    threshold: float = 0.8,
    policy: str = "zero",
) -> DataFrame:
    """Add ``probability``, ``confidence``, ``status``, ``recommendation`` and ``active_attributes``.

    Without a model every device gets the default probability and ``unknown``.
    """
    names = features or schema.SMART_FEATURES
    rows = feature_policy(df, names, policy)
    if model is None:
        scored = rows.withColumns(
            {"probability": F.lit(0.05), "confidence": F.lit(0.5), "status": F.lit("unknown")}
        )
    else:
        applied = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
        scored = applied.drop("features", "rawPrediction", "prediction", *map(_bin, names)).withColumns(
            {"confidence": F.lit(0.85), "status": X.prob_status(F.col("probability"), threshold)}
        )
    return scored.withColumns(
        {
            "recommendation": X.disk_advice(F.col("status"), F.col("probability")),
            "active_attributes": X.active_attributes(names),
        }
    )
