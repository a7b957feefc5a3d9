"""Isolation forest (Liu, Ting and Zhou, 2008) as Spark jobs.

Each tree sees a small hashed sample, so building is one grouped job over bounded
groups; scoring is an Arrow UDF over the whole table with the forest (at most
``trees * (2 * sample - 1)`` nodes) in its closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.ordered import exact_quantiles

NODE_COLUMNS = "tree int, node int, feature int, threshold double, left int, right int, path double"
_EULER = 0.5772156649015329
_HASH_RANGE = 2**40


def average_path(size: int) -> float:
    """Mean path length of an unsuccessful search among ``size`` points."""
    if size <= 1:
        return 0.0
    if size == 2:
        return 1.0
    return 2.0 * (np.log(size - 1.0) + _EULER) - 2.0 * (size - 1.0) / size


def grow(sample: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes ``(node, feature, threshold, left, right, path)`` of one tree; feature -1 marks a leaf."""
    limit = int(np.ceil(np.log2(max(len(sample), 2))))
    nodes: list[tuple[int, int, float, int, int, float]] = []
    open_nodes = [(0, np.arange(len(sample)), 0)]
    created = 1
    while open_nodes:
        node, members, depth = open_nodes.pop()
        values = sample[members]
        low, high = values.min(axis=0), values.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(members))))
            continue
        feature = int(rng.choice(usable))
        # Below the maximum, so that neither side is empty.
        threshold = min(rng.uniform(low[feature], high[feature]), np.nextafter(high[feature], low[feature]))
        goes_left = values[:, feature] <= threshold
        left, right = created, created + 1
        created += 2
        nodes.append((node, feature, float(threshold), left, right, 0.0))
        open_nodes.append((left, members[goes_left], depth + 1))
        open_nodes.append((right, members[~goes_left], depth + 1))
    return nodes


@dataclass(frozen=True)
class IsolationForestModel:
    """Forest, sample size and the two cut-offs found on the training data."""

    features: tuple[str, ...]
    nodes: pd.DataFrame
    sample: int
    offset: float
    threshold: float

    def raw_scores(self, df: DataFrame, name: str = "raw_score") -> DataFrame:
        """Negative anomaly measure in [-1, 0); lower is more unusual."""
        tables = []
        for _, tree in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            tables.append(tuple(tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "path")))
        scale = max(average_path(self.sample), 1e-12)

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                x = np.column_stack([c.to_numpy(dtype="float64") for c in columns])
                rows = np.arange(len(x))
                total = np.zeros(len(x))
                for feature, threshold, left, right, path in tables:
                    at = np.zeros(len(x), dtype="int64")
                    inner = feature[at] >= 0
                    while inner.any():
                        here = at[inner]
                        goes_left = x[rows[inner], feature[here]] <= threshold[here]
                        at[inner] = np.where(goes_left, left[here], right[here])
                        inner = feature[at] >= 0
                    total += path[at]
                yield pd.Series(-np.power(2.0, -total / len(tables) / scale))

        return df.withColumn(name, score(*[F.col(f).cast("double") for f in self.features]))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (negative on the unusual side) and ``is_anomaly``."""
        scored = self.raw_scores(df).withColumn("score", F.col("raw_score") - self.offset).drop("raw_score")
        return scored.withColumn("is_anomaly", F.col("score") < self.threshold)

    def to_tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        nodes = spark.createDataFrame(self.nodes, NODE_COLUMNS)
        row = [(list(self.features), self.sample, self.offset, self.threshold)]
        columns = "features array<string>, sample int, offset double, threshold double"
        return nodes, spark.createDataFrame(row, columns)

    @staticmethod
    def from_tables(nodes: DataFrame, params: DataFrame) -> IsolationForestModel:
        p = params.first()
        return IsolationForestModel(tuple(p["features"]), nodes.toPandas(), p["sample"], p["offset"], p["threshold"])


def fit_isolation_forest(
    df: DataFrame,
    features: list[str],
    key: list[str],
    trees: int = 100,
    sample: int = 256,
    contamination: float = 0.01,
    threshold_percent: float = 1.0,
    seed: int = 42,
) -> IsolationForestModel:
    """Fit on rows identified by ``key``.

    Rows enter by hash: first a pool of about ``trees * sample`` rows, then from
    it each tree's own sample.  The hash makes the sample the same after a
    recomputed task.  The offset and the threshold are exact quantiles of the
    scores of *all* rows.
    """
    rows = df.select(*key, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    total = rows.count()
    if total == 0:
        raise ValueError("no rows to fit on")
    pool_share = min(1.0, trees * sample / total)
    tree_share = min(1.0, 1.5 * sample / (total * pool_share))
    size = min(sample, total)

    def part(*columns) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(_HASH_RANGE))

    pool = rows.where(part(*key) < int(pool_share * _HASH_RANGE))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    drawn = drawn.withColumn("_draw", part(F.lit("tree"), F.col("tree"), *key))
    drawn = drawn.where(F.col("_draw") < int(tree_share * _HASH_RANGE))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        chosen = pdf.sort_values(["_draw", *features]).head(size)[features].to_numpy(dtype="float64")
        grown = grow(chosen, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(grown, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    nodes = drawn.select("tree", "_draw", *features).groupBy("tree").applyInPandas(build, NODE_COLUMNS).toPandas()
    unset = IsolationForestModel(tuple(features), nodes, size, 0.0, 0.0)
    cuts = exact_quantiles(
        unset.raw_scores(rows).withColumn("_all", F.lit(1)), ["_all"], "raw_score",
        {"offset": contamination, "cut": threshold_percent / 100},
    ).first()
    return IsolationForestModel(
        tuple(features), nodes, size, float(cuts["offset"]), float(cuts["cut"] - cuts["offset"])
    )
