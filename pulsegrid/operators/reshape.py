"""Pivot, unpivot, alignment, spines, fills of missing values, column selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid import schema
from pulsegrid.functions import expressions as X
from pulsegrid.operators.ordered import checked_broadcast, join_nullsafe
from pulsegrid.sources.points import duration

# Steps of a series' spine that are made from one row.
SPINE_STEPS = 10_000


# ---- pivots ----------------------------------------------------------------------------
def pivot_fields(
    points: DataFrame, keys: list[str], fields: list[str], name: Column | None = None, agg: str = "avg"
) -> DataFrame:
    """One column per field.  The list is explicit, so no job runs to discover it."""
    named = points.withColumn("_name", name if name is not None else F.col("field"))
    named = named.where(F.col("_name").isin(fields))
    return named.groupBy(*keys).pivot("_name", fields).agg(getattr(F, agg)("value"))


def measurement_field(measurement: str = "measurement", field: str = "field") -> Column:
    """``cpu_usage_user`` from ``cpu`` and ``usage_user``."""
    return F.concat_ws("_", measurement, field)


def unpivot_fields(
    wide: DataFrame, keys: list[str], fields: list[str], drop_nulls: bool = True
) -> DataFrame:
    """Wide to long: ``(keys, field, value)``, values as double."""
    doubles = [F.col(f).cast("double").alias(f) for f in fields]
    long = wide.select(*keys, *doubles).unpivot(keys, fields, "field", "value")
    return long.where(F.col("value").isNotNull()) if drop_nulls else long


def explode_metrics(df: DataFrame, column: str = "metrics", key: str = "metric") -> DataFrame:
    """A ``MAP<STRING, STRUCT>`` column to one row per entry with the struct's fields as columns."""
    rest = [c for c in df.columns if c != column]
    entries = df.select(*rest, F.explode(column).alias(key, "_details"))
    return entries.select(*rest, key, "_details.*")


# ---- alignment ---------------------------------------------------------------------------
def align(frames: list[tuple[str, DataFrame]], keys: list[str], prefix: bool = True) -> DataFrame:
    """Full outer alignment of wide frames on ``keys``; repeated keys are averaged first.

    Expressed as one append and one aggregation instead of a chain of outer
    joins: a single shuffle, whatever the number of frames.
    """
    columns: list[str] = []
    parts = []
    for name, df in frames:
        values = [c for c in df.columns if c not in keys]
        labels = [f"{name}_{c}" if prefix else c for c in values]
        columns += labels
        parts.append(df.select(*keys, *[F.col(c).cast("double").alias(n) for c, n in zip(values, labels)]))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part, allowMissingColumns=True)
    return long.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])


def regularize(df: DataFrame, keys: list[str], step: str, ts: str = "ts", stretch: int = SPINE_STEPS) -> DataFrame:
    """Add a row for every missing step between the first and last time of each series.

    ``df`` holds at most one row per series and step, at the step's start.  The
    spine is as long as the series' own calendar span; it is made of stretches of
    ``stretch`` steps, so no row holds the whole of it as an array.
    """
    every = F.expr(f"INTERVAL {duration(step)}")
    long = every * stretch
    span = df.groupBy(*keys).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    starts = span.select(*keys, "_last", F.explode(F.sequence("_first", "_last", long)).alias("_from"))
    spread = starts.repartition(*keys, "_from")
    upto = F.least(F.col("_from") + long - every, F.col("_last"))
    spine = spread.select(*keys, F.explode(F.sequence("_from", upto, every)).alias(ts))
    return join_nullsafe(spine, df, [*keys, ts], "left")


def hour_spine(series: DataFrame) -> DataFrame:
    """Every row repeated for the 24 hours of the day."""
    return series.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(schema.SLOTS - 1))))


# ---- columns -------------------------------------------------------------------------------
def prefix_columns(df: DataFrame, name: str, keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{name}_{c}") for c in df.columns])


def public_columns(df: DataFrame, time: str = "_time") -> DataFrame:
    """Drop columns that start with an underscore and expose the time as ``timestamp``."""
    hidden = [c for c in df.columns if c.startswith("_") and c != time]
    return df.drop(*hidden).withColumnRenamed(time, "timestamp")


def numeric_cols(df: DataFrame, first: int | None = None) -> list[str]:
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return names if first is None else names[:first]


def fill_const(df: DataFrame, values: dict[str, float]) -> DataFrame:
    return df.na.fill(values)


def feature_policy(df: DataFrame, features: list[str], policy: str = "zero") -> DataFrame:
    """Make every feature a double column.

    ``zero`` adds missing columns as 0 and turns nulls into 0; ``reject`` raises
    when a column is missing and drops rows with a null feature.
    """
    missing = [f for f in features if f not in df.columns]
    if policy == "reject":
        if missing:
            raise ValueError(f"missing features: {', '.join(missing)}")
        return df.withColumns({f: F.col(f).cast("double") for f in features}).dropna(subset=features)
    if policy != "zero":
        raise ValueError(f"unknown policy: {policy}")
    zero = F.lit(0.0)
    return df.withColumns(
        {f: zero if f in missing else F.coalesce(F.col(f).cast("double"), zero) for f in features}
    )


# ---- collection filters ----------------------------------------------------------------------
def allow_fields(points: DataFrame, spec: dict[str, list[str]] | DataFrame) -> DataFrame:
    """Keep listed (measurement, field) pairs.  A table of pairs becomes a semi join."""
    if isinstance(spec, DataFrame):
        return points.join(checked_broadcast(spec), ["measurement", "field"], "left_semi")
    keep = F.lit(False)
    for measurement, fields in spec.items():
        keep = keep | ((F.col("measurement") == measurement) & F.col("field").isin(fields))
    return points.where(keep)


def filter_tags(
    points: DataFrame,
    tag: str,
    allow: list[str] | None = None,
    deny: list[str] | DataFrame | None = None,
    measurement: str | None = None,
) -> DataFrame:
    """Filter by a tag column; with ``measurement`` other measurements pass untouched.

    Rows without the tag pass a deny list and fail an allow list.
    """
    value = F.col(tag)
    if isinstance(deny, DataFrame):
        if measurement is not None:
            hit = (F.col("p.measurement") == measurement) & (F.col(f"p.{tag}") == F.col(f"d.{tag}"))
        else:
            hit = F.col(f"p.{tag}") == F.col(f"d.{tag}")
        return points.alias("p").join(checked_broadcast(deny).alias("d"), hit, "left_anti")
    keep = F.lit(True)
    if allow is not None:
        keep = keep & F.coalesce(value.isin(allow), F.lit(False))
    if deny is not None:
        keep = keep & ~F.coalesce(value.isin(deny), F.lit(False))
    if measurement is not None:
        keep = (F.col("measurement") != measurement) | keep
    return points.where(keep)


def collection_filters(points: DataFrame) -> DataFrame:
    """The shipped collection rules: fields, file systems, devices and interfaces."""
    out = allow_fields(points, schema.COLLECTED_FIELDS)
    rules = [
        ("disk", "fstype", None, schema.IGNORED_FILESYSTEMS),
        ("diskio", "name", schema.DISK_DEVICES, None),
        ("net", "interface", schema.NET_INTERFACES, None),
    ]
    for measurement, tag, allow, deny in rules:
        if tag in out.columns:
            out = filter_tags(out, tag, allow, deny, measurement)
    return out


def convert_fields(wide: DataFrame, integers: list[str], floats: list[str]) -> DataFrame:
    """Listed columns to whole numbers (fraction cut off) or doubles; unreadable text becomes null."""
    changes = {}
    for name in integers:
        if name in wide.columns:
            number = F.col(name).try_cast("double")
            cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
            changes[name] = cut.cast("bigint")
    for name in floats:
        if name in wide.columns:
            changes[name] = F.col(name).try_cast("double")
    return wide.withColumns(changes) if changes else wide


def derive_pressure(wide: DataFrame) -> DataFrame:
    """``cpu_pressure`` and ``mem_pressure`` where their inputs exist."""
    out = wide
    if "usage_user" in wide.columns and "usage_system" in wide.columns:
        out = out.withColumn("cpu_pressure", X.cpu_pressure(F.col("usage_user"), F.col("usage_system")))
    if "used_percent" in wide.columns:
        out = out.withColumn("mem_pressure", X.mem_pressure(F.col("used_percent")))
    return out


def cpu_total(wide: DataFrame, name: str = "cpu_total") -> DataFrame:
    """User plus system time, user time alone where system is missing."""
    if "usage_user" not in wide.columns:
        raise ValueError("CPU usage fields not found")
    total = F.col("usage_user")
    if "usage_system" in wide.columns:
        total = F.coalesce(F.col("usage_user") + F.col("usage_system"), F.col("usage_user"))
    return wide.withColumn(name, total)


def literal_table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A small configuration table."""
    return spark.createDataFrame(rows, columns)


def with_tag_set(points: DataFrame) -> DataFrame:
    """Add ``tag_set``, one text per set of tags: sorted ``key=value`` pairs joined by commas.

    Commas, equals signs and backslashes in keys and values are escaped, so different sets
    have different texts.  Points without tags have an empty one.
    """
    if "tags" not in points.columns:
        return points.withColumn("tag_set", F.lit(""))

    def escaped(text: Column) -> Column:
        return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\,=])", r"\\$1")

    pairs = F.transform(
        F.array_sort(F.map_entries("tags")), lambda e: F.concat(escaped(e["key"]), F.lit("="), escaped(e["value"]))
    )
    return points.withColumn("tag_set", F.coalesce(F.array_join(pairs, ","), F.lit("")))
