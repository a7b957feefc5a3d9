"""Disk health from SMART attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid import schema
from pulsegrid.functions import expressions as X

# --- Fixed values: attribute, offset, scale, weight ---------------------------------
FAILURE_FACTORS = [
    ("reallocated_sector_ct", 0, 100, 0.4),
    ("pending_sector_ct", 0, 50, 0.3),
    ("uncorrectable_errors", 0, 10, 0.2),
    ("temperature_celsius", 60, 40, 0.1),
    ("power_on_hours", 20000, 40000, 0.1),
]
DEFAULT_PROBABILITY = 0.05
MAX_PROBABILITY = 0.95


def smart_wide(attributes: DataFrame, keys: list[str]) -> DataFrame:
    """Attribute rows to one row per report; non-numeric raw values become null."""
    named = attributes.select(*keys, "attr", F.col("raw").try_cast("bigint").alias("_raw"))
    return named.groupBy(*keys).pivot("attr", schema.SMART_SCORE_ATTRIBUTES).agg(F.max("_raw"))


def disk_failure_score() -> Column:
    """Failure probability from the attribute columns.

    Each attribute above its offset contributes its excess over the scale (at
    most 1); weights are renormalised over the contributing attributes; the
    result is at most 0.95, and 0.05 when nothing contributes.
    """
    score, weight = F.lit(0.0), F.lit(0.0)
    for name, offset, scale, share in FAILURE_FACTORS:
        excess = F.col(name) - offset
        present = F.coalesce(excess > 0, F.lit(False))
        factor = F.least(excess / scale, F.lit(1.0))
        score = score + F.when(present, factor * share).otherwise(0.0)
        weight = weight + F.when(present, share).otherwise(0.0)
    probability = F.least(F.try_divide(score, weight), F.lit(MAX_PROBABILITY))
    return F.when(weight > 0, probability).otherwise(DEFAULT_PROBABILITY)


def score_disks(wide: DataFrame) -> DataFrame:
    """Add ``failure_probability`` and ``health_status``; absent attribute columns count as missing."""
    missing = {n: F.lit(None).cast("bigint") for n in schema.SMART_SCORE_ATTRIBUTES if n not in wide.columns}
    full = wide.withColumns(missing) if missing else wide
    scored = full.select("*", X.once(disk_failure_score()).alias("failure_probability"))
    return scored.withColumn("health_status", X.disk_health(F.col("failure_probability")))
