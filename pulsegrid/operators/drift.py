"""Drift of a series against its first rows, in moments and in distribution, and retraining flags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import ordered
from pulsegrid.session import materialize

# Tasks a series' windows are spread over when they meet their first one.
SALTS = 16


def drift(
    series: DataFrame,
    keys: list[str],
    order: list[str],
    window: int = 1000,
    threshold: float = 0.1,
    indexed: bool = False,
) -> DataFrame:
    """Mean and deviation per ``window`` rows, and their relative shift from the first window.

    ``retrain`` when either shift exceeds the threshold.  Rows are numbered cell
    by cell; the windows are partial aggregates.
    """
    numbered = series if indexed else ordered.series_index(series, keys, order)
    bucket = F.floor(F.col("rn") / window).cast("bigint").alias("bucket")
    stats = numbered.groupBy(*keys, bucket).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )
    stats = materialize(stats, "drift-windows")  # read twice; numbering the rows is the larger part
    base = stats.where(F.col("bucket") == 0).select(
        *keys, F.col("mean").alias("base_mean"), F.col("std").alias("base_std")
    )
    joined = ordered.join_nullsafe(stats, base, keys)

    def shift(now: str, then: str) -> Column:
        return F.abs(F.try_divide(F.col(now) - F.col(then), F.abs(F.col(then))))

    shifted = joined.withColumns(
        {"mean_shift": shift("mean", "base_mean"), "std_shift": shift("std", "base_std")}
    )
    beyond = F.greatest("mean_shift", "std_shift") > threshold
    return shifted.withColumn("retrain", F.coalesce(beyond, F.lit(False))).drop("base_mean", "base_std")


def _apart(now: Column, base: Column) -> Column:
    """Struct of ``ks`` and ``wasserstein`` of two sorted arrays of values; null fields if one is empty.

    One walk over the values of both: ``run`` is the difference of the two distribution functions so far, in
    units of 1 / (length of both multiplied), so whole numbers; equal values are passed together.
    """
    n, m = F.size(now).cast("long"), F.size(base).cast("long")
    ours = F.transform(now, lambda x: F.struct(x.alias("value"), m.alias("step")))
    theirs = F.transform(base, lambda x: F.struct(x.alias("value"), (-n).alias("step")))
    start = F.struct(F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("run"),
                     F.lit(0).cast("long").alias("most"), F.lit(0.0).alias("area"))

    def walk(seen: Column, at: Column) -> Column:
        passed = F.when(at["value"].eqNullSafe(seen["value"]), 0).otherwise(F.abs(seen["run"]))
        gap = F.when(seen["run"] == 0, 0.0).otherwise(F.coalesce(at["value"] - seen["value"], F.lit(0.0)))
        return F.struct(
            at["value"].alias("value"), (seen["run"] + at["step"]).alias("run"),
            F.greatest(seen["most"], passed).alias("most"), (seen["area"] + F.abs(seen["run"]) * gap).alias("area"),
        )

    return F.aggregate(
        F.sort_array(F.concat(ours, theirs)), start, walk,
        lambda end: F.struct(
            F.try_divide(end["most"].cast("double"), n * m).alias("ks"), F.try_divide(end["area"], n * m).alias("wasserstein")
        ),
    )


def distribution_shift(
    series: DataFrame,
    keys: list[str],
    order: list[str],
    window: int = 1000,
    threshold: float = 0.1,
    alpha: float = 0.05,
    indexed: bool = False,
) -> DataFrame:
    """How far the values of each ``window`` rows are from those of the first window of their series.

    ``ks``: largest difference of the two empirical distribution functions (Kolmogorov and Smirnov);
    ``critical``: what it passes with probability ``alpha`` if both windows come from one distribution
    (asymptotic); ``wasserstein``: area between the functions, in units of the value; ``n``: values of the
    window.  ``retrain`` when ``ks`` is beyond both ``threshold`` and ``critical``, so that a short last
    window does not raise it by chance.

    A row of the work holds the sorted values of one window.  Rows are numbered once; the first windows, one a
    series, meet the others by (series, salt), so a series with a large share of all rows is spread.  Null
    values count as rows but have no value; a window without any, or whose first window has none, has null
    distances.  Values must not be NaN or infinite.
    """
    numbered = series if indexed else ordered.series_index(series, keys, order)
    bucket = F.floor(F.col("rn") / window).cast("bigint").alias("bucket")
    values = F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("_values")
    windows = materialize(numbered.groupBy(*keys, bucket).agg(values), "shift-windows")
    first = windows.where(F.col("bucket") == 0).select(*keys, F.col("_values").alias("_base"))
    met = ordered.salted_lookup(windows, first, keys, ["bucket"], SALTS).withColumn("_d", _apart(F.col("_values"), F.col("_base")))
    n, m = F.size("_values").cast("long"), F.size("_base").cast("long")
    critical = math.sqrt(-math.log(alpha / 2) / 2) * F.sqrt(F.try_divide((n + m).cast("double"), n * m))
    out = met.select(*keys, "bucket", n.alias("n"), F.col("_d.ks").alias("ks"), critical.alias("critical"), F.col("_d.wasserstein").alias("wasserstein"))
    beyond = F.col("ks") > F.greatest("critical", F.lit(threshold))
    return out.withColumn("retrain", F.coalesce(beyond, F.lit(False)))


def performance_drop(before: Column, after: Column, threshold: float = 0.05) -> Column:
    """True when an error measure grew by more than the threshold, relative to before."""
    return F.coalesce(F.try_divide(after - before, F.abs(before)) > threshold, F.lit(False))
