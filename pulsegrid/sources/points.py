"""Point tables: time-bounded scans, lookbacks, union of several tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.expressions import hour_start
from pulsegrid.operators.ordered import union_all

Time = datetime | str | Column


def as_time(value: Time) -> Column:
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def in_range(df: DataFrame, start: Time | None, stop: Time | None, ts: str = "ts") -> DataFrame:
    """Half-open range ``[start, stop)`` on the bare time column, so it reaches the file scan."""
    out = df
    if start is not None:
        out = out.where(F.col(ts) >= as_time(start))
    if stop is not None:
        out = out.where(F.col(ts) < as_time(stop))
    return out


def select_points(
    points: DataFrame,
    start: Time | None = None,
    stop: Time | None = None,
    measurement: str | None = None,
    host: str | None = None,
    fields: list[str] | None = None,
) -> DataFrame:
    """Range plus equality filters; several fields are an OR."""
    out = in_range(points, start, stop)
    if measurement is not None:
        out = out.where(F.col("measurement") == measurement)
    if host is not None:
        out = out.where(F.col("host") == host)
    if fields is not None:
        out = out.where(F.col("field").isin(fields))
    return out


def read_points(
    spark: SparkSession,
    path: str | list[str],
    start: Time | None = None,
    stop: Time | None = None,
    measurement: str | None = None,
    host: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Scan one or several point tables written by ``sinks.append_points``.

    Tables partitioned by ``day`` are pruned by the same range.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    paths = [path] if isinstance(path, str) else path
    points = union_all([reader.parquet(p) for p in paths])
    points = select_points(points, start, stop, measurement, host)
    if "day" in points.columns:
        if start is not None:
            points = points.where(F.col("day") >= F.to_date(as_time(start)))
        if stop is not None:
            points = points.where(F.col("day") <= F.to_date(as_time(stop)))
    return points


def lookback(df: DataFrame, now: Time, interval: str, ts: str = "ts") -> DataFrame:
    """Rows of the last ``interval`` (``30 days``, ``60 minutes``) before ``now``."""
    since = as_time(now) - F.expr(f"INTERVAL {_interval(interval)}")
    return in_range(df, since, now, ts)


def default_range(
    df: DataFrame, start: Time | None = None, stop: Time | None = None, now: Time | None = None, ts: str = "ts"
) -> DataFrame:
    """The last hour when bounds are missing.

    Without ``now`` the newest time in the table counts as now (and is included).  A table with a ``day``
    column of the times' dates, as ``sinks.append_points`` partitions by, is asked for its newest day first
    (file footers), so only that day's times and the days of the range are read; other tables are read for it.
    """
    if start is not None and stop is not None:
        return in_range(df, start, stop, ts)
    if now is not None:
        begin = start if start is not None else as_time(now) - F.expr("INTERVAL 1 HOUR")
        return in_range(df, begin, stop if stop is not None else now, ts)
    by_day = "day" in df.columns
    latest = df.where(F.col("day") == F.lit(df.agg(F.max("day")).first()[0])) if by_day else df
    end = F.lit(latest.agg(F.max(ts)).first()[0]).cast("timestamp_ntz")
    begin = start if start is not None else end - F.expr("INTERVAL 1 HOUR")
    days = df.where(F.col("day") >= F.to_date(as_time(begin))) if by_day else df
    if stop is not None:
        return in_range(days, begin, stop, ts)
    return in_range(days, begin, None, ts).where(F.col(ts) <= end)


def _interval(text: str) -> str:
    """``60 minutes`` as is, ``5m`` and the like spelled out; anything else is refused."""
    return duration(text)


# Short duration units.
DURATION_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}


def duration(text: str) -> str:
    """A checked interval literal from ``1m``, ``24h`` or ``5 minutes``."""
    parts = text.strip().split()
    if len(parts) == 1:
        number, unit = text.strip()[:-1], text.strip()[-1:]
        unit = DURATION_UNITS.get(unit, "")
    elif len(parts) == 2:
        number, unit = parts
    else:
        number, unit = "", ""
    allowed = {u.rstrip("s") for u in DURATION_UNITS.values()}
    if not (number.isascii() and number.isdigit()) or int(number) < 1 or unit.rstrip("s").lower() not in allowed:
        raise ValueError(f"not a duration: {text!r}")
    return f"{int(number)} {unit.lower()}"


def hourly_series(points: DataFrame, keys: tuple[str, ...] = ("host",), field: str = "field") -> DataFrame:
    """Hourly mean per series: ``(host, metric, ts, value)``.

    The partial aggregate reduces every task's rows to one per series and hour
    before the shuffle; the result has at most 24 rows per series and day.
    """
    return points.groupBy(*keys, F.col(field).alias("metric"), hour_start(F.col("ts")).alias("ts")).agg(
        F.avg("value").alias("value")
    )
