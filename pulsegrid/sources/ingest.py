"""Ingest of submitted metrics (JSON) and row validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schema
from pulsegrid.functions.expressions import parse_ts
from pulsegrid.operators.ordered import checked_broadcast, join_nullsafe
from pulsegrid.session import materialize

# Field values stay text until ``to_points`` so that one odd value does not void the row.
_WIRE = T.StructType(
    [
        T.StructField("measurement", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("timestamp", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Ingested:
    """``points`` to append, ``rejects`` with index and reason, ``counts`` per batch."""

    points: DataFrame
    rejects: DataFrame
    counts: DataFrame


def parse_submitted(json_df: DataFrame, column: str = "json") -> DataFrame:
    parsed = json_df.withColumn("_m", F.from_json(column, _WIRE))
    return parsed.select(*[c for c in json_df.columns if c != column], "_m.*")


def to_points(parsed: DataFrame, now: Column) -> DataFrame:
    """One row per field; text fields keep their text and a null value."""
    number = F.col("_text").try_cast("double")
    exploded = parsed.select("*", F.explode("fields").alias("field", "_text"))
    return exploded.select(
        F.coalesce(parse_ts(F.col("timestamp")), now).alias("ts"),
        "measurement",
        F.try_element_at("tags", F.lit("host")).alias("host"),
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
        "field",
        number.alias("value"),
        F.when(number.isNull(), F.col("_text")).alias("text"),
    )


def ingest_metrics(
    json_df: DataFrame, now: Column, strict: bool = True, max_batch: int = schema.MAX_BATCH
) -> Ingested:
    """Submitted metrics ``(batch_id, index, json)`` to points.

    Lenient: the measurement defaults to ``custom`` and nothing is refused but
    unreadable JSON and times.  Strict: rows without measurement or fields are
    rejected with their index, and so is every row of a batch over ``max_batch``.
    A row without a time gets ``now``; one whose time cannot be read is rejected.

    Batches are counted from ``batch_id`` alone; only the list of those over ``max_batch``, at most one for so
    many rows, meets the rows, by broadcast while its counted size allows.
    """
    parsed = parse_submitted(json_df)
    unreadable = F.col("measurement").isNull() & F.col("tags").isNull() & F.col("fields").isNull()
    unreadable = unreadable & F.col("timestamp").isNull()
    bad_time = F.col("timestamp").isNotNull() & parse_ts(F.col("timestamp")).isNull()
    if strict:
        sizes = json_df.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_size"))
        oversized = materialize(sizes.where(F.col("_size") > max_batch), "oversized-batches")
        parsed = join_nullsafe(parsed, checked_broadcast(oversized), ["batch_id"], "left")
        reason = F.when(F.col("_size").isNotNull(), f"more than {max_batch} metrics in the batch").when(
            F.col("measurement").isNull() | F.col("fields").isNull(), "missing required fields"
        ).when(bad_time, "unreadable time")
        checked = parsed.withColumn("reason", reason).drop("_size")
    else:
        checked = parsed.withColumn("reason", F.when(unreadable, "unreadable").when(bad_time, "unreadable time"))
        checked = checked.withColumn("measurement", F.coalesce("measurement", F.lit("custom")))
    good = checked.where(F.col("reason").isNull()).drop("reason")
    rejects = checked.where(F.col("reason").isNotNull()).select("batch_id", "index", "reason")
    counts = checked.groupBy("batch_id").agg(
        F.count_if(F.col("reason").isNull()).alias("points_written"),
        F.count_if(F.col("reason").isNotNull()).alias("errors"),
    )
    return Ingested(to_points(good, now), rejects, counts)


def validate_rows(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejects; ``reason`` names the first rule that does not hold (null counts as that)."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    checked = df.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def query_rules() -> list[tuple[str, Column]]:
    """Rules for metric query rows: host, metric type, aggregation, window, limit."""
    return [
        ("host", F.length("host").between(1, 255)),
        ("metric_type", F.col("metric_type").isin(schema.METRIC_TYPES)),
        ("aggregation", F.col("aggregation").isin(schema.AGGREGATIONS)),
        ("window", F.col("window").rlike("^[0-9]+[smh]$")),
        ("limit", F.col("limit").between(1, schema.MAX_LIMIT)),
    ]


def alert_rule_rules() -> list[tuple[str, Column]]:
    """Rules for alert configuration rows."""
    return [
        ("host", F.length("host") >= 1),
        ("metric", F.col("metric").isNotNull()),
        ("threshold", F.col("threshold").isNotNull()),
        ("operator", F.col("operator").isin(schema.OPERATORS)),
        ("severity", F.col("severity").isin(schema.SEVERITIES)),
        ("cooldown_minutes", F.col("cooldown_minutes").between(1, 1440)),
    ]
