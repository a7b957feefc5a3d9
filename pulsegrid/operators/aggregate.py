"""Windowed aggregates, profiles, statistics, trend, summaries, error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.functions import scores as S
from pulsegrid.operators import ordered
from pulsegrid.operators.reshape import regularize, with_tag_set
from pulsegrid.sources.points import duration

KEYS = list(schema.SERIES_KEYS)


# ---- windows over time --------------------------------------------------------------------
def aggregate_window(
    points: DataFrame, keys: list[str], every: str, fn: str = "mean", label: str = "start", value: str = "value"
) -> DataFrame:
    """One row per series and non-empty window: ``(keys, ts, value)``.

    ``label`` says which end of the window ``ts`` shows.
    """
    if fn not in schema.AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {fn}")
    if label not in ("start", "stop"):
        raise ValueError(f"unknown label: {label}")
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[fn](value)
    end = "start" if label == "start" else "end"
    windowed = points.groupBy(*keys, F.window("ts", duration(every)).alias("_window")).agg(agg.alias("value"))
    return windowed.select(*keys, F.col(f"_window.{end}").alias("ts"), "value")


def basic_stats(points: DataFrame, keys: list[str], period: str = "60 seconds") -> DataFrame:
    """Mean, minimum, maximum and sample deviation per series and period.

    The input stays as it is; this is an additional table.
    """
    windowed = points.groupBy(*keys, F.window("ts", duration(period)).alias("_window")).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.stddev_samp("value").alias("stdev"),
        F.count("value").alias("n"),
    )
    return windowed.select(*keys, F.col("_window.start").alias("ts"), "mean", "min", "max", "stdev", "n")


def resample_mean(
    wide: DataFrame, keys: list[str], step: str = "1 minute", columns: list[str] | None = None
) -> DataFrame:
    """Mean of every column per step, with empty rows for steps without data."""
    names = columns or [c for c in wide.columns if c not in (*keys, "ts")]
    means = wide.groupBy(*keys, F.window("ts", duration(step)).alias("_window")).agg(
        *[F.avg(c).alias(c) for c in names]
    )
    return regularize(means.select(*keys, F.col("_window.start").alias("ts"), *names), keys, step)


# ---- days and hours ---------------------------------------------------------------------------
def daily_peaks(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.max("value").alias("day_max"), F.min("value").alias("day_min")
    )


def day_span(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Calendar days from the first to the last one, and days that have data."""
    return daily_peaks(series, keys).groupBy(*keys).agg(
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("span_days"),
        F.count("day").alias("observed_days"),
    )


def peak_baseline(peaks: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Highest daily maximum, lowest daily minimum and the calendar span.

    Days without data add to the span but not to the extremes.
    """
    return peaks.groupBy(*keys).agg(
        F.max("day_max").alias("hist_max"),
        F.min("day_min").alias("hist_min"),
        (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"),
    )


def hourly_stats(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Distribution per hour of day."""
    return series.groupBy(*keys, F.hour("ts").alias("hour")).agg(
        F.count("value").alias("hour_n"),
        F.avg("value").alias("hour_mean"),
        F.stddev_pop("value").alias("hour_std"),
    )


def hourly_profile(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Mean per hour of day for all 24 hours, 0 where an hour has no data."""
    stats = hourly_stats(series, keys).select(*keys, "hour", F.col("hour_mean").alias("_value"))
    by_hour = F.map_from_entries(F.collect_list(F.struct("hour", "_value")))
    per_series = stats.groupBy(*keys).agg(by_hour.alias("_hours"))
    hours = F.sequence(F.lit(0), F.lit(schema.SLOTS - 1))
    spread = per_series.select(*keys, "_hours", F.explode(hours).alias("hour"))
    value = F.coalesce(F.try_element_at("_hours", F.col("hour")), F.lit(0.0))
    return spread.select(*keys, "hour", value.alias("profile"))


# ---- statistics ---------------------------------------------------------------------------------
def series_stats(series: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return series.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.var_pop("value").alias("var"),
    )


def iqr_bounds(
    series: DataFrame, keys: list[str] = KEYS, multiplier: float = 1.5, bounded: bool = True
) -> DataFrame:
    """Quartiles, interquartile range and fences, exact with linear interpolation.

    ``bounded`` input (hourly means) uses the built-in percentile; raw points go
    through ``ordered.exact_quantiles``, which no single task has to hold.
    """
    if bounded:
        both = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("_q")
        grouped = series.groupBy(*keys).agg(F.count("value").alias("n"), both)
        quartiles = grouped.select(*keys, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
    else:
        quartiles = ordered.exact_quantiles(series, keys, "value", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return quartiles.withColumns(
        {
            "iqr": iqr,
            "low_fence": F.col("q1") - multiplier * iqr,
            "high_fence": F.col("q3") + multiplier * iqr,
        }
    )


def anomaly_threshold(
    scores: DataFrame, keys: list[str], percent: float = 1.0, score: str = "score"
) -> DataFrame:
    """The score below which ``percent`` percent of the rows lie, interpolated."""
    return ordered.exact_quantiles(scores, keys, score, {"threshold": percent / 100})


def trend(
    series: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None, bounded: bool = True
) -> DataFrame:
    """Linear trend over the sample index: ``n, mean, slope, r2, trend``.

    Below 10 values slope and r2 are 0.  A constant series has r2 0 (the built-in
    function says 1).  ``bounded=False`` numbers raw points cell by cell; the
    regression itself is a partial aggregate either way.
    """
    order = order or ["ts"]
    if bounded:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        indexed = series.withColumn("rn", position)
    else:
        indexed = ordered.series_index(series, keys, order)
    x, y = F.col("rn").cast("double"), F.col("value")
    fitted = indexed.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("_var"),
        F.regr_slope(y, x).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"),
    )
    enough = F.col("n") >= 10
    slope = F.when(enough, F.col("_slope")).otherwise(0.0)
    r2 = F.when(enough & (F.col("_var") != 0), F.col("_r2")).otherwise(0.0)
    with_fit = fitted.select(*keys, "n", "mean", slope.alias("slope"), r2.alias("r2"))
    return with_fit.withColumn("trend", S.trend_direction(F.col("n"), F.col("slope"), F.col("mean")))


# ---- risk summaries -----------------------------------------------------------------------------
def risk_summary(overall: DataFrame, keys: list[str]) -> DataFrame:
    """Hours in total and by level."""
    return overall.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_hours"),
        F.count_if(F.col("overall_level") == "critical").alias("critical_hours"),
        F.count_if(F.col("overall_level") == "warning").alias("warning_hours"),
    )


def metric_risk(risk: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return risk.groupBy(*keys).agg(F.avg("risk").alias("avg_risk"), F.max("risk").alias("max_risk"))


def method_contribution(risk: DataFrame, keys: list[str], weights: dict[str, float]) -> DataFrame:
    """Average score per method next to its weight."""
    long = risk.select(*keys, *schema.METHODS).unpivot(keys, schema.METHODS, "method", "score")
    weight = F.lit(0.0)
    for method, value in weights.items():
        weight = F.when(F.col("method") == method, float(value)).otherwise(weight)
    return long.groupBy(*keys, "method").agg(F.avg("score").alias("avg_score")).withColumn("weight", weight)


def high_risk(overall: DataFrame, threshold: float = 0.5, score: str = "overall_risk") -> DataFrame:
    """Slots at or above the warning threshold; unlike the level this includes equality."""
    return overall.where(F.col(score) >= threshold)


def anomaly_summary(scored: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Counts, rate as share and percent, mean score over rows with ``score`` and ``is_anomaly``."""
    total = F.count(F.lit(1))
    hits = F.count_if(F.col("is_anomaly"))
    return scored.groupBy(*keys).agg(
        hits.alias("anomaly_count"),
        total.alias("total_points"),
        (hits / total).alias("anomaly_rate"),
        (hits / total * 100).alias("anomaly_pct"),
        F.avg(score).alias("mean_score"),
        (hits > 0).alias("is_anomalous"),
    )


def disk_summary(scored: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.max("probability").alias("max_probability"),
        F.bool_or(F.col("probability") > threshold).alias("above_threshold"),
    )


def last_per_series(points: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The newest row per series by a partial aggregate, not by a sort."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_newest")
    return points.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def dashboard_metrics(points: DataFrame, order: list[str], measurements: tuple[str, ...] = ("cpu", "mem", "disk")) -> DataFrame:
    """Mean of the latest values over all series of a measurement, with unit, status and penalty.

    Points with different tags (one of several disks) are different series.
    """
    tagged = with_tag_set(points.where(F.col("measurement").isin(list(measurements))))
    latest = last_per_series(tagged, [*schema.POINT_KEYS, "tag_set"], order, ["value"])
    means = latest.groupBy("host", "measurement").agg(F.avg("value").alias("value"))
    return means.select(
        "host",
        "measurement",
        "value",
        F.when(F.col("measurement").isin("cpu", "mem"), "%").otherwise("GB").alias("unit"),
        X.usage_status(F.col("value")).alias("status"),
        X.usage_penalty(F.col("value")).alias("penalty"),
    )


def dashboard_summary(points: DataFrame, order: list[str]) -> DataFrame:
    """All hosts at once: value and status per measurement and the health score."""
    metrics = dashboard_metrics(points, order)
    picks = []
    for name in ("cpu", "mem", "disk"):
        hit = F.col("measurement") == name
        picks.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}_value"))
        picks.append(F.max(F.when(hit, F.col("status"))).alias(f"{name}_status"))
    health = F.greatest(F.lit(0), 100 - F.sum("penalty")).cast("int").alias("health_score")
    return metrics.groupBy("host").agg(*picks, health)


def alert_counts(alerts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Active alerts in total and by the two upper severities."""
    active = F.col("status") == "active"
    return alerts.groupBy(*(keys or ["host"])).agg(
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(active & (F.col("severity") == "warning")).alias("warning"),
    )


def point_counts(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"))


# ---- error measures ---------------------------------------------------------------------------
def regression_metrics(df: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """MAE, MSE, RMSE, MAPE (rows with y = 0 left out) and R2 over rows with both values."""
    both = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    error = F.col(y) - F.col(yhat)
    sse, sst = F.sum(error * error), F.var_pop(y) * F.count(y)
    return both.groupBy(*keys).agg(
        F.count(y).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error / F.nullif(F.col(y), F.lit(0.0)))).alias("mape"),
        (1 - sse / F.nullif(sst, F.lit(0.0))).alias("r2"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes, from one count per (label, prediction)."""
    cells = df.groupBy(F.col(label).cast("int").alias("l"), F.col(prediction).cast("int").alias("p")).count()
    per_class = cells.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("class"))

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))

    is_l, is_p = F.col("l") == F.col("class"), F.col("p") == F.col("class")
    sums = per_class.groupBy("class").agg(
        total(is_l & is_p).alias("_tp"), total(is_l).alias("support"), total(is_p).alias("_predicted")
    )
    tp = F.col("_tp")
    return sums.select(
        "class",
        F.coalesce(F.try_divide(tp, F.col("_predicted")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp, F.col("support")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * tp, F.col("_predicted") + F.col("support")), F.lit(0.0)).alias("f1"),
        "support",
    )


def roc_auc(df: DataFrame, keys: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums, ties at their average rank.

    Works on counts per distinct score, and on running totals of value buckets and
    their parts, so equal or dense scores do not gather in one task.
    """
    place = [ordered.value_bucket(F.col(score)).alias("_bucket"), ordered.value_part(F.col(score)).alias("_part")]
    counts = df.groupBy(*keys, *place, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    parts = counts.groupBy(*keys, "_bucket", "_part").agg(F.sum("_neg").alias("_neg"))
    buckets = parts.groupBy(*keys, "_bucket").agg(F.sum("_neg").alias("_neg"))

    def before(by: list[str], order: str) -> Column:
        frame = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_neg").over(frame), F.lit(0))

    totals = buckets.select(*keys, "_bucket", before(keys, "_bucket").alias("_of_buckets"))
    of_parts = parts.withColumn("_of_parts", before([*keys, "_bucket"], "_part")).drop("_neg")
    offsets = ordered.join_nullsafe(of_parts, totals, [*keys, "_bucket"])
    offsets = offsets.select(*keys, "_bucket", "_part", (F.col("_of_buckets") + F.col("_of_parts")).alias("_below"))
    local = counts.withColumn("_within", before([*keys, "_bucket", "_part"], "_score"))
    ranked = ordered.join_nullsafe(local, offsets, [*keys, "_bucket", "_part"])
    wins = F.col("_pos") * (F.col("_below") + F.col("_within") + F.col("_neg") / 2)
    pos, neg = F.sum("_pos"), F.sum("_neg")
    return ranked.groupBy(*keys).agg(
        pos.alias("positives"), neg.alias("negatives"), F.try_divide(F.sum(wins), pos * neg).alias("auc")
    )
