"""Scalar expressions: levels, clamps, derived metrics, messages, time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


# ---- levels and statuses -----------------------------------------------------------
def risk_level(score: Column, warning: float = 0.5, critical: float = 0.7) -> Column:
    """Strict comparisons: a score equal to a threshold stays below it."""
    return F.when(score > critical, "critical").when(score > warning, "warning").otherwise("normal")


def level_num(level: Column) -> Column:
    return F.when(level == "critical", 2).when(level == "warning", 1).otherwise(0)


def disk_health(probability: Column) -> Column:
    return F.when(probability > 0.8, "critical").when(probability > 0.5, "warning").otherwise("healthy")


def prob_status(probability: Column, threshold: float = 0.8) -> Column:
    """Status of a model probability; the warning band starts at 70 % of the threshold."""
    return (
        F.when(probability > threshold, "critical")
        .when(probability > threshold * 0.7, "warning")
        .otherwise("healthy")
    )


def severity_of_ratio(ratio: Column) -> Column:
    """Null below the info bound: no alert."""
    return F.when(ratio >= 0.9, "critical").when(ratio >= 0.8, "warning").when(ratio >= 0.7, "info")


def usage_status(value: Column) -> Column:
    return F.when(value < 80, "normal").when(value < 90, "warning").otherwise("critical")


def usage_penalty(value: Column) -> Column:
    """Health points lost.  Exactly 90 costs 10 though its status is critical."""
    return F.when(value > 90, 20).when(value > 80, 10).otherwise(0)


def compare(value: Column, op: Column, threshold: Column) -> Column:
    """Comparison chosen by operator name; null for an unknown name."""
    return (
        F.when(op == "gt", value > threshold)
        .when(op == "lt", value < threshold)
        .when(op == "eq", value == threshold)
        .when(op == "gte", value >= threshold)
        .when(op == "lte", value <= threshold)
    )


# ---- clamps --------------------------------------------------------------------------
def cap(value: Column, upper: float) -> Column:
    return F.least(value, F.lit(float(upper)))


def floor_at(value: Column, lower: float) -> Column:
    return F.greatest(value, F.lit(float(lower)))


def clamp(value: Column, lower: float, upper: float) -> Column:
    return floor_at(cap(value, upper), lower)


# ---- derived metrics -------------------------------------------------------------------
def cpu_pressure(user: Column, system: Column) -> Column:
    return F.when(user.isNotNull(), user + system)


def mem_pressure(used_percent: Column) -> Column:
    return floor_at(used_percent - 80, 0.0) / 20


# ---- time --------------------------------------------------------------------------------
def floor_div(value: Column, divisor: int) -> Column:
    """Whole-number division rounding down, without a detour through double."""
    whole = F.lit(divisor).cast("bigint")
    return F.call_function("div", value - F.pmod(value, whole), whole)


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds; sessions run in UTC, so wall-clock columns convert unchanged."""
    return floor_div(epoch_micros(ts), MICROS)


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def epoch_nanos(ts: Column) -> Column:
    return epoch_micros(ts) * 1000


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    """date_trunc returns TIMESTAMP even for TIMESTAMP_NTZ input, hence the cast back."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def parse_ts(text: Column) -> Column:
    """ISO text with an optional ``Z`` or offset to UTC wall-clock time; null when unreadable."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / MICROS


# ---- text ----------------------------------------------------------------------------------
def percent_text(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def exceeds_message(metric: Column, value: Column, threshold: Column) -> Column:
    return F.format_string("%s at %.2f is beyond its limit of %.2f", metric, value, threshold)


# Metrics measured in percent and metrics that are shares of one.
PERCENT_METRICS = ["cpu_usage", "memory_usage", "disk_usage"]
SHARE_METRICS = ["anomaly_rate", "disk_failure"]


def rule_message(metric: Column, value: Column, threshold: Column) -> Column:
    """The message of a broken rule in the unit of its metric."""
    text = "%s at %s is beyond its limit of %s"
    share, percent = metric.isin(SHARE_METRICS), metric.isin(PERCENT_METRICS)
    return (
        F.when(share, F.format_string(text, metric, percent_text(value), percent_text(threshold)))
        .when(percent, F.format_string(text, metric, percent_text(value / 100), percent_text(threshold / 100)))
        .otherwise(exceeds_message(metric, value, threshold))
    )


def disk_advice(status: Column, probability: Column) -> Column:
    return F.concat(
        F.when(status == "critical", "Back up and replace the disk now")
        .when(status == "warning", "Plan a disk replacement")
        .when(status == "healthy", "No action needed")
        .otherwise("No SMART readings"),
        F.lit(", failure probability "),
        percent_text(probability),
    )


def active_attributes(names: list[str]) -> Column:
    """Names of the columns whose value is above zero, in the given order."""
    marks = [F.when(F.col(n) > 0, F.lit(n)) for n in names]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def null_safe_equal(left: str, right: str, names: list[str]) -> Column:
    """Join condition over two aliases, with null equal to null."""
    parts = [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names]
    return reduce(lambda a, b: a & b, parts)


def once(value: Column) -> Column:
    """``value`` as a generated column, computed once per row: a generator of one element keeps the optimizer
    from repeating the expression wherever its name is used."""
    return F.explode(F.array(value))
