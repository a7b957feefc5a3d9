"""Streaming sources, windowed statistics, scoring, alerts, the scoring loop."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.functions import scores as S
from pulsegrid.operators import alerts as L
from pulsegrid.operators.ordered import checked_broadcast
from pulsegrid.schema import DEFAULT_RISK, RiskParams
from pulsegrid.session import shared_dir
from pulsegrid.sources.points import duration


def stream_points(
    spark: SparkSession,
    path: str,
    table_schema: T.StructType = schema.POINTS,
    glob: str | None = None,
    max_files: int = 1000,
) -> DataFrame:
    """A file feed of points.  Event time becomes TIMESTAMP, which watermarks require."""
    reader = spark.readStream.schema(table_schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    points = reader.parquet(path)
    return points.withColumn("ts", F.col("ts").cast("timestamp"))


def rounded(points: DataFrame, interval: str = "10 seconds") -> DataFrame:
    """Times rounded down to the collection interval."""
    start = F.window("ts", duration(interval)).start
    return points.withColumn("ts", start)


def stream_basic_stats(
    points: DataFrame, keys: list[str], period: str = "60 seconds", late: str = "10 minutes"
) -> DataFrame:
    """``aggregate.basic_stats`` on a stream: windows close once the watermark passes them."""
    windowed = (
        points.withWatermark("ts", late)
        .groupBy(*keys, F.window("ts", duration(period)).alias("_window"))
        .agg(
            F.avg("value").alias("mean"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.stddev_samp("value").alias("stdev"),
            F.count("value").alias("n"),
        )
    )
    return windowed.select(*keys, F.col("_window.start").alias("ts"), "mean", "min", "max", "stdev", "n")


def stream_aggregate_window(
    points: DataFrame, keys: list[str], every: str, fn: str = "mean", late: str = "10 minutes"
) -> DataFrame:
    """``aggregate.aggregate_window`` on a stream."""
    if fn not in schema.AGGREGATIONS:
        raise ValueError(f"unknown aggregation: {fn}")
    agg = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "count": F.count}[fn]("value")
    windowed = (
        points.withWatermark("ts", late)
        .groupBy(*keys, F.window("ts", duration(every)).alias("_window"))
        .agg(agg.alias("value"))
    )
    return windowed.select(*keys, F.col("_window.start").alias("ts"), "value")


def sliding_stats(
    points: DataFrame, keys: list[str], size: str = "60 minutes", slide: str = "1 minute", late: str | None = "10 minutes"
) -> DataFrame:
    """Mean and deviation over a sliding time window, on a stream or (``late=None``) a table.

    Every point belongs to ``size / slide`` windows.  To not multiply raw points,
    they are first summed per slide; only those sums are spread over the windows.
    """
    if _seconds(size) % _seconds(slide):
        raise ValueError("the window must be a multiple of the slide")
    source = points if late is None else points.withWatermark("ts", late)
    step = source.groupBy(*keys, F.window("ts", duration(slide)).alias("_slide")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.count("value") * F.var_pop("value")).alias("m2")
    )
    # The slides of a window are few; their structs are folded in time order by Chan's update.
    part = F.struct(F.col("_slide.start").alias("at"), "n", "mean", "m2")
    windows = step.where("n > 0").groupBy(*keys, F.window("_slide", duration(size), duration(slide)).alias("_window"))

    def fold(state, x):
        n = state["n"] + x["n"]
        apart = x["mean"] - state["mean"]
        mean = state["mean"] + apart * x["n"] / n
        m2 = state["m2"] + x["m2"] + apart * apart * state["n"] * x["n"] / n
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    folded = windows.agg(F.array_sort(F.collect_list(part)).alias("_parts")).withColumn("_w", F.aggregate("_parts", none, fold))
    std = F.sqrt(F.greatest(F.col("_w.m2"), F.lit(0.0)) / F.col("_w.n"))
    return folded.select(
        *keys, F.col("_window.start").alias("ts"), F.col("_w.n").alias("n"), F.col("_w.mean").alias("mean"), std.alias("std")
    )


def _seconds(text: str) -> int:
    number, unit = duration(text).split()
    # Seconds per unit.
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")]


def stream_score(
    points: DataFrame,
    baseline: DataFrame,
    hours: DataFrame,
    keys: tuple[str, ...] = schema.SERIES_KEYS,
    params: RiskParams = DEFAULT_RISK,
) -> DataFrame:
    """Score stream points against stored baselines with the time-free scorers.

    The static sides hold one row per series (and hour); Spark broadcasts them
    when their size allows and joins by shuffle otherwise.
    """
    rows = points.withColumn("hour", F.hour("ts"))
    stats = baseline.select(*keys, "n", "mean", "std", "q1", "q3")
    joined = rows.join(stats, list(keys)).join(
        hours.select(*keys, "hour", "hour_n", "hour_mean", "hour_std"), [*keys, "hour"], "left"
    )
    methods = ("zscore", "iqr", "pattern")
    scored = joined.withColumns({m: S.SCORERS[m](F.col("value"), params) for m in methods})
    score = F.greatest(*[F.col(m) for m in methods])
    level = X.risk_level(F.col("score"), params.warning, params.critical)
    return scored.withColumn("score", score).select(
        *[c for c in points.columns], *methods, "score", level.alias("level")
    )


def stream_alerts(
    points: DataFrame, rules: DataFrame, keys: tuple[str, ...] = schema.SERIES_KEYS, late: str = "10 minutes"
) -> DataFrame:
    """Rule breaks on the stream, each once even when its point is delivered again.

    Rules are applied first, so points of one series and time with different values are
    judged apart, and the state holds broken rules only.
    """
    rule = checked_broadcast(rules.withColumnsRenamed({"host": "rule_host", "metric": "rule_metric"}))
    applies = F.col("rule_host").isNull() | (F.col("rule_host") == F.col("host"))
    broken = X.compare(F.col("value"), F.col("operator"), F.col("threshold"))
    marked = points.withWatermark("ts", late)
    hits = marked.join(rule, (F.col("metric") == F.col("rule_metric")) & applies & broken)
    same = [*keys, "ts", "value", *(c for c in rule.columns if c != "rule_metric")]
    once = hits.dropDuplicatesWithinWatermark(list(dict.fromkeys(same)))
    return L.to_alerts(once.drop("rule_host", "rule_metric"), ["host", "metric", "ts", "threshold"])


def run_available(df: DataFrame, purpose: str, output: str = "append") -> DataFrame:
    """Run a stream over everything that is there into a parquet table, and read that back.

    Table and checkpoint live in the shared folder.
    """
    spark = df.sparkSession
    path, log = shared_dir(spark, purpose), shared_dir(spark, f"{purpose}-log")
    query = (
        df.writeStream.outputMode(output).format("parquet")
        .option("checkpointLocation", log).option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


# A time behind all others that pandas can hold.
END = datetime(2262, 1, 1)


def run_to_end(points: DataFrame, rule: Callable[[DataFrame], DataFrame], purpose: str) -> DataFrame:
    """``run_available`` of ``rule(points)`` for a feed that has ended: also what the watermark has not passed.

    After everything that is there, the same stream meets one more row, which has nothing but a time far
    behind all others.  It moves the watermark over all points and is itself held for good.
    """
    spark = points.sparkSession
    path, log, end = (shared_dir(spark, f"{purpose}{part}") for part in ("", "-log", "-end"))
    spark.createDataFrame([], points.schema).write.parquet(end)
    out = rule(points.unionByName(spark.readStream.schema(points.schema).parquet(end)))

    def run() -> None:
        writer = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", log)
        writer.option("path", path).trigger(availableNow=True).start().awaitTermination()

    run()
    last = [F.lit(END).cast(kind).alias(name) if name == "ts" else F.lit(None).cast(kind).alias(name) for name, kind in points.dtypes]
    spark.range(1).select(*last).write.mode("append").parquet(end)
    run()
    return spark.read.schema(out.schema).parquet(path)


def stream_cycle(
    points: DataFrame,
    cycle: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval: str = "300 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """Run the prediction cycle on every micro-batch."""
    writer = points.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": duration(interval)}
    return writer.trigger(**trigger).start()


def retain(df: DataFrame, now, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days; on a table partitioned by ``day`` whole partitions are skipped."""
    limit = F.lit(str(now)).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    out = df.where(F.col(ts) >= limit)
    return out.where(F.col("day") >= F.to_date(limit)) if "day" in df.columns else out
