"""Line protocol text: ``measurement,tag=v field=v,field="text" time_in_ns``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.expressions import epoch_nanos, floor_div, once

# Escapes of the format.
_TAG_SPECIAL = r"([,= \\])"
_TEXT_SPECIAL = r"([\"\\])"
_NAME = r"(?:[^,= \\]++|\\.)++"
_FIELD_VALUE = r"\"(?:[^\"\\]++|\\.)*+\"|[^, \"]+"
_LINE = rf"^((?:[^, \\]++|\\.)++)((?:,{_NAME}={_NAME})*) ((?:{_NAME}=(?:{_FIELD_VALUE}),?)+)(?: (-?[0-9]+))?\s*$"


def _escape(text: Column, special: str) -> Column:
    return F.regexp_replace(text, special, r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(.)", "$1")


def to_line_protocol(
    df: DataFrame, measurement: str | Column, tags: list[str], fields: list[str], ts: str = "ts"
) -> DataFrame:
    """One ``line`` per row; null tags and fields are left out, rows without any field too.

    Whole numbers get the ``i`` suffix, text is quoted.
    """
    types = dict(df.dtypes)
    name = F.lit(measurement) if isinstance(measurement, str) else measurement
    head = [_escape(name, r"([, \\])")]
    for tag in tags:
        head.append(F.concat(F.lit(f"{tag}="), _escape(F.col(tag).cast("string"), _TAG_SPECIAL)))
    body = []
    for field in fields:
        kind = types[field]
        if kind == "string":
            value = F.concat(F.lit('"'), _escape(F.col(field), _TEXT_SPECIAL), F.lit('"'))
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            value = F.concat(F.col(field).cast("string"), F.lit("i"))
        else:
            value = F.col(field).cast("string")
        body.append(F.concat(F.lit(f"{field}="), value))
    values = F.concat_ws(",", *body)
    line = F.concat_ws(" ", F.concat_ws(",", *head), F.col("_values"), epoch_nanos(F.col(ts)).cast("string"))
    full = df.select("*", once(values).alias("_values")).where(F.col("_values") != "")
    return full.withColumn("line", line).drop("_values")


def parse_line_protocol(text_df: DataFrame, text: str = "line", keep: list[str] | None = None) -> DataFrame:
    """Lines to ``(measurement, tags, ts, field, value, text)``, one row per field.

    Lines that do not fit the format, comments and blanks yield nothing.  Numbers
    go to ``value`` (booleans as 1 and 0), quoted strings to ``text``.
    """
    keep = keep or []
    line = F.col(text)
    # all groups by one match, with NUL between them; a line that has that character itself is matched for each group
    apart = F.split(F.regexp_replace(line, _LINE, "$1\0$2\0$3\0$4"), "\0")
    each = F.when(line.rlike(_LINE), F.array(*[F.regexp_extract(line, _LINE, i) for i in range(1, 5)]))
    groups = F.when(line.contains("\0"), each).otherwise(apart)
    matched = text_df.select(*keep, once(groups).alias("_g")).where(F.size("_g") == 4)
    split = matched.select(*keep, *[F.col("_g")[i].alias(n) for i, n in enumerate(("_head", "_tags", "_fields", "_ns"))])
    tag, field = F.lit(rf",({_NAME})=({_NAME})"), F.lit(rf"({_NAME})=({_FIELD_VALUE})")

    def names(column: str, pattern: Column) -> Column:
        return F.transform(F.regexp_extract_all(column, pattern, F.lit(1)), _unescape)

    def raw(column: str, pattern: Column) -> Column:
        return F.regexp_extract_all(column, pattern, F.lit(2))

    micros = floor_div(F.col("_ns").try_cast("bigint"), 1000)
    pairs = F.arrays_zip(names("_fields", field).alias("name"), raw("_fields", field).alias("raw"))
    of_line = F.struct(
        _unescape(F.col("_head")).alias("measurement"),
        F.map_from_arrays(names("_tags", tag), F.transform(raw("_tags", tag), _unescape)).alias("tags"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"),
        pairs.alias("pairs"),
    )
    parsed = split.select(*keep, once(of_line).alias("_l"))  # before the fields part, so not once for each
    rows = parsed.select(*keep, "_l.measurement", "_l.tags", "_l.ts", F.explode("_l.pairs").alias("_f"))
    value = F.col("_f.raw")
    is_text = value.startswith('"')
    lowered = F.lower(value)
    number = (
        F.when(is_text, None)
        .when(lowered.isin("t", "true"), 1.0)
        .when(lowered.isin("f", "false"), 0.0)
        .otherwise(F.regexp_replace(value, "[iu]$", "").try_cast("double"))
    )
    return rows.select(
        *keep,
        "measurement",
        "tags",
        "ts",
        F.col("_f.name").alias("field"),
        number.alias("value"),
        F.when(is_text, _unescape(F.expr("substring(_f.raw, 2, length(_f.raw) - 2)"))).alias("text"),
    )
