"""Row-order operators: fills, tails, moving statistics, EWMA, sequences, splits.

``bounded=True`` means calendar-bounded input (one row per series and step of a
fixed grid, e.g. hourly means): a plain window per series.  ``bounded=False`` is
for raw points and goes through ``operators.ordered``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators import ordered

KEYS = list(schema.SERIES_KEYS)
SEED_ROWS = 10
DAY_SECONDS = 86_400


def ffill_bfill(
    grid: DataFrame, keys: list[str], columns: list[str], ts: str = "ts", seconds: int = DAY_SECONDS
) -> DataFrame:
    """Forward fill, then backward fill, within each series of a regular grid.

    Rows are ordered per (series, time cell); one summary row per cell carries the
    last values on.  After the forward fill only rows before the first value are
    empty, so the backward fill is that first value.
    """
    celled = ordered.with_cells(grid, keys, ts, seconds)
    seen = {c: F.when(F.col(c).isNotNull(), F.col(ts)) for c in columns}
    cells = celled.groupBy(*ordered.CELL).agg(
        *[F.max_by(c, seen[c]).alias(f"_last_{c}") for c in columns], *[F.min_by(c, seen[c]).alias(f"_first_{c}") for c in columns]
    )
    series = Window.partitionBy("_key").orderBy("_cell")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = cells.select(
        *ordered.CELL,
        *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_last_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(whole).alias(f"_first_{c}") for c in columns],
    )
    ahead = Window.partitionBy(*ordered.CELL).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    local = celled.withColumns({f"_here_{c}": F.last(c, ignorenulls=True).over(ahead) for c in columns})
    filled = {c: F.coalesce(f"_here_{c}", f"_last_{c}", f"_first_{c}") for c in columns}
    return local.join(carried, ordered.CELL).withColumns(filled).select(*grid.columns)


def tail_n(
    series: DataFrame, n: int, keys: list[str] = KEYS, order: list[str] | None = None, salts: int = ordered.SALTS
) -> DataFrame:
    """The newest ``n`` rows per series; ``rank`` 1 is the newest."""
    order = order or ["ts"]
    return ordered.top_n(series, keys, [F.col(c).desc() for c in order], n, order, salts)


def limit_per_series(
    df: DataFrame, keys: list[str], n: int, order: list[str] | None = None, salts: int = ordered.SALTS
) -> DataFrame:
    """The first ``n`` rows per series in time order, ``n`` between 1 and 10,000."""
    if not 1 <= n <= schema.MAX_LIMIT:
        raise ValueError(f"limit out of range: {n}")
    order = order or ["ts"]
    return ordered.top_n(df, keys, [F.col(c).asc() for c in order], n, order, salts).drop("rank")


def anomaly_details(scored: DataFrame, keys: list[str], k: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first ``k`` anomalous rows per key in time order."""
    return limit_per_series(scored.where("is_anomaly"), keys, k, order)


def _frame(df: DataFrame, keys: list[str], order: list[str], before: int, bounded: bool, block_rows: int):
    """The frame's input and its partition keys, order and flag for surplus rows."""
    if bounded:
        return df, keys, order, None
    indexed = ordered.series_index(df, keys, order)
    return ordered.with_blocks(indexed, before, block_rows), [*keys, "block"], ["rn"], "halo"


def _finish(df: DataFrame, surplus: str | None) -> DataFrame:
    return df if surplus is None else df.where(~F.col(surplus)).drop("halo", "block", "rn")


def moving_stats(
    series: DataFrame,
    n: int = 7,
    keys: list[str] = KEYS,
    order: list[str] | None = None,
    bounded: bool = True,
    include_current: bool = False,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """Mean and population deviation of the ``n`` rows before each row.

    Adds ``ma_n``, ``ma_mean`` and ``ma_std``; null statistics without history.
    ``include_current`` makes it the last ``n`` rows up to and including the row.
    """
    order = order or ["ts"]
    df, part, sort, surplus = _frame(series, keys, order, n, bounded, block_rows)
    spec = Window.partitionBy(*part).orderBy(*sort)
    frame = spec.rowsBetween(-(n - 1), 0) if include_current else spec.rowsBetween(-n, -1)
    out = df.withColumns(
        {
            "ma_n": F.count("value").over(frame),
            "ma_mean": F.avg("value").over(frame),
            "ma_std": F.stddev_pop("value").over(frame),
        }
    )
    return _finish(out, surplus)


def rate_of_change(
    series: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None, bounded: bool = True
) -> DataFrame:
    """Change to the row before: ``change``, ``per_second`` and ``relative``."""
    order = order or ["ts"]
    if bounded:
        spec = Window.partitionBy(*keys).orderBy(*order)
        df = series.withColumns({"prev_ts": F.lag("ts").over(spec), "prev_value": F.lag("value").over(spec)})
    else:
        df = ordered.previous_row(series, keys, order, ["ts", "value"])
    change = F.col("value") - F.col("prev_value")
    return df.withColumns(
        {
            "change": change,
            "per_second": F.try_divide(change, X.seconds_between(F.col("ts"), F.col("prev_ts"))),
            "relative": F.try_divide(change, F.col("prev_value")),
        }
    ).drop("prev_ts", "prev_value")


def ewma_reach(alpha: float) -> int:
    """Rows back after which a weight is zero in double precision."""
    return math.ceil(1080 * math.log(2) / -math.log1p(-alpha)) if alpha < 1 else 1


def ewma_over(whole: WindowSpec, alpha: float) -> Column:
    """Final average of a numbered series (``rn`` from 0, ``n`` rows) as a window expression.

    The weights add up to 1, so it is the first value plus the weighted distances
    from it; for a constant series that is the value itself, without rounding.
    """
    value, rn, n = F.col("value"), F.col("rn"), F.col("n")
    start = F.max(F.when(rn == 0, value)).over(whole)
    decay = F.pow(F.lit(1 - alpha), (n - 1 - rn).cast("double"))
    return start + F.sum(alpha * decay * (value - start)).over(whole)


def ewma_variance_terms(n: Column, rn: Column, value: Column, ewma: Column, alpha: float) -> Column:
    decay = F.pow(F.lit(1 - alpha), (n - 1 - rn).cast("double"))
    return alpha * decay * (value - ewma) * (value - ewma)


def ewma_stats(
    series: DataFrame,
    alpha: float = 0.3,
    keys: list[str] = KEYS,
    order: list[str] | None = None,
    bounded: bool = True,
) -> DataFrame:
    """Final EWMA and EW variance per series: ``n, ewma, ewma_var, ewma_std``.

    Closed forms instead of a fold.  The variance measures every deviation from
    the final average and starts from the variance of the first ten values.
    Raw points are numbered cell by cell; then only rows whose weight is not
    exactly zero in double precision, and the first ten, are looked at.
    """
    order = order or ["ts"]
    whole = Window.partitionBy(*keys)
    if bounded:
        indexed = series.withColumns(
            {"rn": F.row_number().over(whole.orderBy(*order)) - 1, "n": F.count(F.lit(1)).over(whole)}
        )
    else:
        indexed = ordered.series_index(series, keys, order, total="n")
        weighty = F.col("n") - 1 - F.col("rn") < ewma_reach(alpha)
        indexed = indexed.where((F.col("rn") < SEED_ROWS) | weighty)
    n, rn, value = F.col("n"), F.col("rn"), F.col("value")
    averaged = indexed.withColumn("ewma", ewma_over(whole, alpha))
    seed = F.var_pop(F.when(rn < SEED_ROWS, value))
    terms = F.sum(ewma_variance_terms(n, rn, value, F.col("ewma"), alpha))
    var = F.pow(F.lit(1 - alpha), F.first("n").cast("double")) * seed + terms
    return (
        averaged.groupBy(*keys)
        .agg(F.first("n").alias("n"), F.first("ewma").alias("ewma"), var.alias("ewma_var"))
        .withColumn("ewma_std", F.sqrt("ewma_var"))
    )


def sequence_windows(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    length: int,
    order: list[str] | None = None,
    bounded: bool = True,
    block_rows: int = ordered.BLOCK_ROWS,
) -> DataFrame:
    """Every ``length`` rows as one array, with the next value of the first column as target.

    Yields ``(keys, ts, window ARRAY<ARRAY<DOUBLE>>, target)`` at the target's
    time, for series of at least ``2 * length`` rows.
    """
    order = order or ["ts"]
    row = F.array(*[F.col(c).cast("double") for c in columns])
    if bounded:
        source = df.withColumn("_count", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        part, sort, surplus = keys, order, None
    else:
        indexed = ordered.series_index(df, keys, order, total="_count")
        source, part, sort, surplus = ordered.with_blocks(indexed, length, block_rows), [*keys, "block"], ["rn"], "halo"
    frame = Window.partitionBy(*part).orderBy(*sort).rowsBetween(-length, -1)
    wide = source.withColumn("window", F.collect_list(row).over(frame))
    if surplus:
        wide = wide.where(~F.col(surplus))
    complete = wide.where((F.size("window") == length) & (F.col("_count") >= 2 * length))
    return complete.select(*keys, *order, "window", F.col(columns[0]).cast("double").alias("target"))


def chrono_split(
    df: DataFrame,
    keys: list[str],
    order: list[str] | None = None,
    train: float = 0.8,
    bounded: bool = True,
) -> DataFrame:
    """Add ``part``: the oldest 80 % are for training, of which the newest 20 % validate.

    Boundaries are cut down to whole rows.
    """
    order = order or ["ts"]
    if bounded:
        whole = Window.partitionBy(*keys)
        indexed = df.withColumns(
            {"rn": F.row_number().over(whole.orderBy(*order)) - 1, "_count": F.count(F.lit(1)).over(whole)}
        )
    else:
        indexed = ordered.series_index(df, keys, order, total="_count")
    test_from = F.floor(F.col("_count") * train)
    val_from = F.floor(test_from * train)
    part = F.when(F.col("rn") < val_from, "train").when(F.col("rn") < test_from, "val").otherwise("test")
    return indexed.withColumn("part", part).drop("rn", "_count")


def hash_split(df: DataFrame, key: list[str], test_percent: int = 20, seed: int = 42) -> DataFrame:
    """Add ``part`` by a hash of the row key: the same rows whatever the partitioning."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(100))
    return df.withColumn("part", F.when(bucket < test_percent, "test").otherwise("train"))


def hour_rank(profile: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """0-based rank of an hour by its profile; the busiest hour has 0, ties go to the later hour."""
    spec = Window.partitionBy(*keys).orderBy(F.col("profile").desc(), F.col("hour").desc())
    return profile.withColumn("hour_rank", F.row_number().over(spec) - 1)


def top_contributors(risk: DataFrame, n: int = 2, above: float = 0.3, keys: tuple[str, ...] = ("host",)) -> DataFrame:
    """The ``n`` riskiest metrics per hour, then only those above a score."""
    spec = Window.partitionBy(*keys, "hour").orderBy(F.col("risk").desc(), F.col("metric"))
    return (
        risk.withColumn("rank", F.row_number().over(spec))
        .where((F.col("rank") <= n) & (F.col("risk") > above))
    )


def minimum_rows(df: DataFrame, keys: list[str], minimum: int, columns: list[str]) -> DataFrame:
    """Per-series results become null below ``minimum`` rows (column ``n``)."""
    return df.withColumns({c: F.when(F.col("n") >= minimum, F.col(c)) for c in columns})
