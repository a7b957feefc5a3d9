"""Alert rules, listings, sustained conditions, gaps, cooldown, grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions import expressions as X
from pulsegrid.operators import ordered
from pulsegrid.sources.points import Time, as_time, duration, lookback

RULE_COLUMNS = "host string, metric string, operator string, threshold double, severity string, cooldown_minutes int"

# --- Fixed values: shipped rules ------------------------------------------------------
DEFAULT_RULES = [
    (None, "cpu_usage", "gt", 90.0, "warning", 5),
    (None, "anomaly_rate", "gt", 0.3, "critical", 5),
    (None, "disk_failure", "gt", 0.8, "critical", 5),
]


def rules_table(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    """Rules as a table; a null host applies to every host."""
    return spark.createDataFrame(DEFAULT_RULES if rules is None else rules, RULE_COLUMNS)


def evaluate_rules(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values ``(host, metric, value, ...)`` that break a rule, with the rule's threshold and severity.

    An equi-join on the metric.  Rules are configuration, so after a count they
    are broadcast; a rule table beyond the bound is joined by shuffle instead.
    """
    rule = ordered.checked_broadcast(rules.withColumnsRenamed({"host": "rule_host", "metric": "rule_metric"}))
    applies = F.col("rule_host").isNull() | (F.col("rule_host") == F.col("host"))
    broken = X.compare(F.col("value"), F.col("operator"), F.col("threshold"))
    joined = values.join(rule, (F.col("metric") == F.col("rule_metric")) & applies & broken)
    return joined.drop("rule_host", "rule_metric")


def to_alerts(broken: DataFrame, id_from: list[str], ts: str = "ts") -> DataFrame:
    """Alert rows with an id derived from their content, so a repeated run yields the same id."""
    content = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in id_from]), {"ignoreNullFields": "false"})
    key = F.sha2(content, 256)
    return broken.select(
        F.substring(key, 1, 16).alias("id"),
        F.col(ts).alias("ts"),
        "host",
        "metric",
        F.col("value").cast("double").alias("value"),
        F.col("threshold").cast("double").alias("threshold"),
        "severity",
        F.lit("active").alias("status"),
        X.rule_message(F.col("metric"), F.col("value"), F.col("threshold")).alias("message"),
    )


def active_alerts(
    alerts: DataFrame,
    now: Time,
    host: str | None = None,
    severity: str | None = None,
    limit: int | None = 100,
    interval: str = "24 hours",
) -> DataFrame:
    """Active alerts of the last 24 hours, oldest first, with defaults for missing columns' values."""
    out = lookback(alerts, now, interval).where(F.col("status") == "active")
    if host is not None:
        out = out.where(F.col("host") == host)
    if severity is not None:
        out = out.where(F.col("severity") == severity)
    message = F.coalesce(F.col("message"), F.lit("")) if "message" in alerts.columns else F.lit("")
    out = out.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce("host", F.lit("unknown")).alias("host"),
        F.coalesce("metric", F.lit("unknown")).alias("metric"),
        F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("threshold", F.lit(0.0)).alias("threshold"),
        F.coalesce("severity", F.lit("warning")).alias("severity"),
        "ts",
        message.alias("message"),
    )
    if limit is None:
        return out
    return out.orderBy("ts", "id").limit(limit)


def sustained(
    points: DataFrame,
    keys: list[str],
    order: list[str],
    condition: Column,
    for_at_least: str,
    seconds: int = ordered.CELL_SECONDS,
) -> DataFrame:
    """Runs of consecutive points that meet a condition for at least a duration.

    Yields ``(keys, run_start, run_end, points, max_value)``.  Raw rows are shuffled
    once, by (series, time cell), and reduced to the runs of each cell.  A run inside a
    cell is complete; only the first and last run of a cell, two rows at most, are
    linked across the cells of a series.
    """
    ts = order[0]
    flagged = ordered.with_cells(points, keys, ts, seconds).withColumn("_hit", F.coalesce(condition, F.lit(False)))
    upto = Window.partitionBy(*ordered.CELL).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("_misses", F.sum((~F.col("_hit")).cast("bigint")).over(upto))
    value = F.when(F.col("_hit"), F.col("value"))
    parts = flagged.groupBy(*ordered.CELL, "_misses").agg(
        F.min(F.when(F.col("_hit"), F.col(ts))).alias("run_start"),
        F.max(F.when(F.col("_hit"), F.col(ts))).alias("run_end"),
        F.count_if("_hit").alias("points"),
        F.max(value).alias("max_value"),
    )
    at_end = F.col("_misses") == F.max("_misses").over(Window.partitionBy(*ordered.CELL))
    parts = parts.withColumn("_at_end", at_end).where((F.col("points") > 0) | F.col("_at_end"))
    # complete runs are partitions of their own, those at the edges of cells share one per series
    inside = (F.col("_misses") > 0) & ~F.col("_at_end")
    parts = parts.withColumn("_inside", F.when(inside, F.struct("_cell", "_misses")))
    linked = Window.partitionBy("_key", "_inside").orderBy("_cell", "_misses")
    begins = (F.col("_misses") > 0) | (F.coalesce(F.lag("points").over(linked), F.lit(0)) == 0)
    runs = parts.withColumn("_begins", begins.cast("bigint"))
    runs = runs.withColumn("_run", F.sum("_begins").over(linked.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.where("points > 0").groupBy("_key", "_inside", "_run").agg(
        F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"),
        F.sum("points").alias("points"), F.max("max_value").alias("max_value"),
    )
    long_enough = F.col("run_end") - F.col("run_start") >= F.expr(f"INTERVAL {duration(for_at_least)}")
    return runs.where(long_enough).select(*[F.col(f"_key.{k}").alias(k) for k in keys], "run_start", "run_end", "points", "max_value")


def gaps(
    points: DataFrame, keys: list[str], order: list[str], longer_than: str, seconds: int = ordered.CELL_SECONDS
) -> DataFrame:
    """Silences between two points of a series longer than a duration."""
    ts = order[0]
    chained = ordered.previous_row(points.select(*keys, *order), keys, order, [ts], seconds)
    silent = F.col(ts) - F.col(f"prev_{ts}") > F.expr(f"INTERVAL {duration(longer_than)}")
    return chained.where(silent).select(
        *keys,
        F.col(f"prev_{ts}").alias("gap_start"),
        F.col(ts).alias("gap_end"),
        X.seconds_between(F.col(ts), F.col(f"prev_{ts}")).alias("gap_seconds"),
    )


def down(points: DataFrame, keys: list[str], now: Time, longer_than: str, ts: str = "ts") -> DataFrame:
    """Series that are silent at ``now`` and have been for longer than a duration.

    ``gaps`` sees silences that ended; this sees those that last.  One partial
    aggregate; points at or after ``now`` do not count.
    """
    moment = as_time(now)
    last = points.where(F.col(ts) < moment).groupBy(*keys).agg(F.max(ts).alias("last_seen"))
    silent = moment - F.col("last_seen") > F.expr(f"INTERVAL {duration(longer_than)}")
    return last.where(silent).withColumn("silent_seconds", X.seconds_between(moment, F.col("last_seen")))


def group_alerts(
    alerts: DataFrame, keys: list[str], order: list[str], interval: str = "300 seconds", per_group: int = 10
) -> DataFrame:
    """Alerts by window, at most ``per_group`` each (the setting's purpose), with the group's full size."""
    grouped = alerts.withColumn("group_start", F.window(order[0], duration(interval)).start)
    group = [*keys, "group_start"]
    sizes = grouped.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"))
    shown = ordered.top_n(grouped, group, [F.col(c) for c in order], per_group, order)
    return ordered.join_nullsafe(shown, sizes, group)


# ---- cooldown ------------------------------------------------------------------------------
# The rule is greedy: after an emitted alert, those of the next ``seconds`` are
# dropped.  Time is cut into chunks.  For one chunk, the time its last emitted
# alert blocks until depends only on the first alert that is let through, which
# lies in the chunk's first ``seconds`` or is the first one after them.  So
# (a) every chunk tabulates "first alert let through -> blocked until" on its own,
# (b) one short pass per key links the tables, (c) every chunk emits on its own.


def _links(times: np.ndarray, width: int) -> np.ndarray:
    """For each time the position of the next alert that is let through after it."""
    return np.searchsorted(times, times + width, side="left")


def cooldown(
    alerts: DataFrame, keys: list[str], seconds: int = 300, ts: str = "ts", tie: str = "id", chunk_seconds: int = 86_400
) -> DataFrame:
    """At most one alert per key and ``seconds``, counted from the last emitted one.

    Of alerts at the same time the one with the smallest ``tie`` counts.
    """
    if chunk_seconds < seconds:
        raise ValueError("a chunk must be at least as long as the cooldown")
    width, chunk_width = seconds * 1_000_000, chunk_seconds * 1_000_000
    types = dict(alerts.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    micros = X.epoch_micros(F.col(ts))
    times = alerts.select(*keys, micros.alias("at")).distinct()
    times = times.withColumn("chunk", X.floor_div(F.col("at"), chunk_width))

    def tabulate(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(pdf["at"].to_numpy(dtype="int64"))
        follow = _links(at, width)
        until = at + width
        for i in range(len(at) - 1, -1, -1):
            if follow[i] < len(at):
                until[i] = until[follow[i]]
        first = int(pdf["chunk"].iloc[0]) * chunk_width
        entries = min(int(np.searchsorted(at, first + width, side="left")) + 1, len(at))
        entry, blocked = at[:entries], until[:entries]
        keep = np.append(blocked[1:] != blocked[:-1], True)
        out = pd.DataFrame({"entry": entry[keep], "until": blocked[keep]})
        for k in [*keys, "chunk"]:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "chunk", "entry", "until"]]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        free_from = np.iinfo("int64").min
        for chunk, table in pdf.sort_values(["chunk", "entry"]).groupby("chunk", sort=True):
            rows.append((chunk, free_from))
            position = int(np.searchsorted(table["entry"].to_numpy(), free_from, side="left"))
            if position < len(table):
                free_from = int(table["until"].iloc[position])
        out = pd.DataFrame(rows, columns=["chunk", "free_from"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "chunk", "free_from"]]

    def emit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(left["at"].to_numpy(dtype="int64"))
        follow = _links(at, width)
        chosen = []
        i = int(np.searchsorted(at, int(right["free_from"].iloc[0]), side="left"))
        while i < len(at):
            chosen.append(at[i])
            i = int(follow[i])
        out = pd.DataFrame({"at": np.array(chosen, dtype="int64")})
        for position, k in enumerate(keys):
            out[k] = left[k].iloc[0]
        return out[[*keys, "at"]]

    tables = times.groupBy(*keys, "chunk").applyInPandas(
        tabulate, f"{key_schema}, chunk bigint, entry bigint, until bigint"
    )
    starts = tables.groupBy(*keys).applyInPandas(link, f"{key_schema}, chunk bigint, free_from bigint")
    group = [*keys, "chunk"]
    emitted = (
        times.groupBy(*group).cogroup(starts.groupBy(*group)).applyInPandas(emit, f"{key_schema}, at bigint")
    )
    rest = [c for c in alerts.columns if c not in keys]
    first = alerts.groupBy(*keys, micros.alias("at")).agg(F.min_by(F.struct(*rest), F.col(tie)).alias("_row"))
    kept = ordered.join_nullsafe(first, emitted, [*keys, "at"])
    return kept.select(*keys, "_row.*").select(*alerts.columns)
