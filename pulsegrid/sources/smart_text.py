"""SMART text reports to attribute rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.expressions import once

# All after the header line; a line with two fields or more, the second as its group.
_AFTER_HEADER = r"(?md)^(?=.*ID#)(?=.*ATTRIBUTE_NAME).*\n?((?s:.*))"
_NAMED_LINE = r"(?md)^\S++ (\S++).*+"


def _is_header(line: Column) -> Column:
    return line.contains("ID#") & line.contains("ATTRIBUTE_NAME")


def _one_spaced(body: Column) -> Column:
    """Lines without spaces at their ends and with one space wherever there is other room in them."""
    return F.regexp_replace(F.regexp_replace(body, r"(?md)^ ++| ++$", ""), r"[ \t\x0B\f\r]{2,}+|[\t\x0B\f\r]", " ")


def _readable(line: Column, p: Column) -> Column:
    """Whether a line with these fields is an attribute: no header, ten fields or more, four of them whole numbers."""
    whole = [F.get(p, F.lit(i)).try_cast("int").isNotNull() for i in (0, 3, 4, 5)]
    return ~_is_header(line) & (F.size(p) >= 10) & whole[0] & whole[1] & whole[2] & whole[3]


def _last_lines(body: Column) -> Column:
    """The attribute lines of a body, of repeated attributes only the last."""
    parsed = F.transform(F.split(body, "\n"), lambda line: F.struct(line.alias("line"), F.split(line, " ").alias("p")))
    named = F.transform(
        F.filter(parsed, lambda x: _readable(x["line"], x["p"])),
        lambda x: F.struct(F.lower(x["p"][1]).alias("attr"), x["line"].alias("line")),
    )
    none = F.array().cast("array<struct<attr:string,line:string>>")
    kept = F.aggregate(named, none, lambda k, a: F.concat(F.filter(k, lambda x: x["attr"] != a["attr"]), F.array(a)))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def _names(body: Column) -> Column:
    """The second field of every line that has one, in lower case."""
    return F.regexp_extract_all(F.lower(body), F.lit(_NAMED_LINE), F.lit(1))


def _bodies(reports: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, _body)``: the lines after the header, where no two attribute lines have the same attribute.

    Only reports that name something twice are read line by line for that.
    """
    after = reports.select(*keys, once(_one_spaced(F.regexp_extract(text, _AFTER_HEADER, 1))).alias("_after"))
    named = after.select(*keys, "_after", once(_names(F.col("_after"))).alias("_names"))
    repeated = F.size(F.array_distinct("_names")) < F.size("_names")
    return named.select(*keys, once(F.when(repeated, _last_lines(F.col("_after"))).otherwise(F.col("_after"))).alias("_body"))


def parse_smart_reports(reports: DataFrame, keys: list[str], text: str = "report") -> DataFrame:
    """``(keys, attr, id, value, worst, threshold, raw)`` for every attribute line after the header.

    Lines with fewer than ten fields or non-numeric numbers are skipped; of
    repeated attributes the last line counts.  A report is one row and stays in its task: there is no shuffle.
    """
    lines = _bodies(reports, keys, text).select(*keys, F.explode(F.split("_body", "\n")).alias("_line"))
    fields = lines.select(*keys, "_line", once(F.split("_line", " ")).alias("_p"))
    p = F.col("_p")
    return fields.where(_readable(F.col("_line"), p)).select(
        *keys,
        F.lower(F.get(p, F.lit(1))).alias("attr"),
        *[F.get(p, F.lit(i)).try_cast("int").alias(name) for i, name in ((0, "id"), (3, "value"), (4, "worst"), (5, "threshold"))],
        F.get(p, F.lit(9)).alias("raw"),
    )


def wide_smart_reports(reports: DataFrame, keys: list[str], names: list[str], text: str = "report") -> DataFrame:
    """One row per report with a column for each named attribute; null when absent or no whole number."""
    body = F.col("_body")
    found = F.struct(_names(body).alias("names"), F.regexp_extract_all(body, F.lit(_NAMED_LINE), F.lit(0)).alias("lines"))
    listed = _bodies(reports, keys, text).select(*keys, once(found).alias("_f"))

    def line(name: str) -> Column:
        return F.get(F.col("_f.lines"), F.array_position(F.col("_f.names"), F.lit(name)).cast("int") - 1)

    lines = listed.select(*keys, once(F.struct(*[line(n).alias(n) for n in names])).alias("_l"))
    split = lines.select(*keys, "_l", once(F.struct(*[F.split(F.col(f"_l.{n}"), " ").alias(n) for n in names])).alias("_p"))

    def raw(name: str) -> Column:
        p = F.col(f"_p.{name}")
        return F.when(_readable(F.col(f"_l.{name}"), p), F.get(p, F.lit(9)).try_cast("bigint"))

    return split.select(*keys, once(F.struct(*[raw(n).alias(n) for n in names])).alias("_wide")).select(*keys, "_wide.*")
