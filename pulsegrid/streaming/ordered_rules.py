"""Rules that read a series in time order, on a stream: sustained conditions, downtime, cooldown.

Points of a series are held in state until the watermark has passed their time, so late
ones still find their place; then they are read in order of time.  State is the points
of the lateness and a few numbers per series.  Results depend neither on how the input
is cut into files nor on the order in which points arrive within the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.expressions import epoch_micros
from pulsegrid.sources.points import duration


class Rule(Protocol):
    """``state`` and ``out`` are DDL; times are microseconds."""

    state: str
    out: str

    def point(self, known: tuple | None, at: int, tie: str, value: float, body: str) -> tuple[tuple | None, list[tuple]]:
        """The next point in time order: new state and output rows."""

    def rest(self, known: tuple | None, passed_ms: int, pending: bool) -> tuple[tuple | None, list[tuple], int | None]:
        """After the points before ``passed_ms``: new state, output rows, and when to look again without new points."""


def _micros(text: str) -> int:
    number, unit = duration(text).split()
    # Seconds per unit.
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}[unit.rstrip("s")] * 1_000_000


class Sustained:
    """A run of points that meet a condition is reported once, at the point that makes it long enough."""

    state = "start bigint, points bigint, most double, reported boolean"
    out = "run_start bigint, raised_at bigint, points bigint, max_value double"

    def __init__(self, micros: int):
        self.micros = micros

    def point(self, known, at, tie, value, body):
        if not body:
            return None, []
        start, points, most, reported = known or (at, 0, value, False)
        points, most = points + 1, max(most, value)
        raised = [] if reported or at - start < self.micros else [(start, at, points, most)]
        return (start, points, most, reported or bool(raised)), raised

    def rest(self, known, passed_ms, pending):
        return known, [], None


class Downtime:
    """A silence is reported once, when it has lasted longer than allowed, whether or not it ends."""

    state = "last bigint"
    out = "last_seen bigint, down_at bigint"

    def __init__(self, micros: int):
        self.micros = micros

    def point(self, known, at, tie, value, body):
        silent = known is not None and at - known[0] > self.micros
        return (at,), [(known[0], known[0] + self.micros)] if silent else []

    def rest(self, known, passed_ms, pending):
        if known is None:
            return None, [], None
        due = known[0] + self.micros
        if due // 1000 < passed_ms:
            return None, [(known[0], due)], None
        return known, [], due // 1000


class Cooldown:
    """After an alert that is let through, those of the next ``micros`` are dropped."""

    state = "until bigint"
    out = "at bigint, body string"

    def __init__(self, micros: int):
        self.micros = micros

    def point(self, known, at, tie, value, body):
        if known is not None and at < known[0]:
            return known, []
        return (at + self.micros,), [(at, body)]

    def rest(self, known, passed_ms, pending):
        if known is None or pending:
            return known, [], None
        return (None, [], None) if known[0] // 1000 < passed_ms else (known, [], known[0] // 1000)


def in_time_order(points: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    """Run a rule over ``(keys, at, tie, value, body)`` of a watermarked stream; points of one time in order of ``tie``."""
    types = dict(points.dtypes)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    names = [x.split()[0] for x in rule.out.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tie, value, body, has, *known = state.get if state.exists else ([], [], [], [], False)
        known = tuple(known) if has else None
        rows = list(zip(at, tie, value, body))
        if not state.hasTimedOut:
            for pdf in batches:
                rows += zip(*(pdf[c].tolist() for c in ("at", "tie", "value", "body")))
        rows.sort(key=lambda r: r[:2])
        passed_ms, found, read = state.getCurrentWatermarkMs(), [], 0
        while read < len(rows) and rows[read][0] // 1000 < passed_ms:
            known, more = rule.point(known, *rows[read])
            found += more
            read += 1
        rows = rows[read:]
        known, more, wake = rule.rest(known, passed_ms, bool(rows))
        found += more
        if known is None and not rows:
            state.remove()
        else:
            held = [list(c) for c in zip(*rows)] or [[], [], [], []]
            blank = (None,) * (rule.state.count(",") + 1)
            state.update((*held, known is not None, *(known or blank)))
            look = [t for t in (rows[0][0] // 1000 if rows else None, wake) if t is not None]
            if look:
                state.setTimeoutTimestamp(max(min(look), passed_ms + 1))
        yield pd.DataFrame([(*key, *r) for r in found], columns=[*keys, *names])

    held_schema = "at array<bigint>, tie array<string>, value array<double>, body array<string>, known boolean"
    return points.groupBy(*keys).applyInPandasWithState(
        run, f"{key_schema}, {rule.out}", f"{held_schema}, {rule.state}", "append", GroupStateTimeout.EventTimeTimeout
    )


def held_points(points: DataFrame, keys: list[str], late: str, tie: Column, value: Column, body: Column) -> DataFrame:
    """Points as ``in_time_order`` reads them."""
    marked = points.withWatermark("ts", late)
    text = F.coalesce(tie.cast("string"), F.lit(""))
    return marked.select(
        *keys, "ts", epoch_micros(F.col("ts")).alias("at"), text.alias("tie"), value.cast("double").alias("value"), body.alias("body")
    )


def stream_sustained(
    points: DataFrame, keys: list[str], condition: Column, for_at_least: str, tie: str = "event_id", late: str = "10 minutes"
) -> DataFrame:
    """Runs of consecutive points that meet a condition, reported when they reach a duration.

    Yields ``(keys, run_start, raised_at, points, max_value)``, the last two up to that moment.
    """
    hit = F.when(F.coalesce(condition, F.lit(False)), "hit").otherwise("")
    held = held_points(points, keys, late, F.col(tie), F.col("value"), hit)
    runs = in_time_order(held, keys, Sustained(_micros(for_at_least)))
    return runs.withColumns({c: F.timestamp_micros(c) for c in ("run_start", "raised_at")})


def stream_downtime(points: DataFrame, keys: list[str], longer_than: str, late: str = "10 minutes") -> DataFrame:
    """``(keys, last_seen, down_at)`` of series that fall silent for longer than a duration, as soon as that is known."""
    held = held_points(points, keys, late, F.lit(""), F.lit(0.0), F.lit(""))
    silences = in_time_order(held, keys, Downtime(_micros(longer_than)))
    return silences.withColumns({c: F.timestamp_micros(c) for c in ("last_seen", "down_at")})


def stream_cooldown(
    alerts: DataFrame, keys: list[str], interval: str = "300 seconds", tie: str = "id", late: str = "10 minutes"
) -> DataFrame:
    """At most one alert per key and interval, counted from the last one let through; same columns as ``alerts``.

    Alerts of one time are taken in order of ``tie`` as text.
    """
    rest = [c for c in alerts.columns if c not in [*keys, "ts"]]
    body = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    held = held_points(alerts, keys, late, F.col(tie), F.lit(0.0), body)
    kept = in_time_order(held, keys, Cooldown(_micros(interval)))
    shape = alerts.select(*rest).schema
    rows = kept.select(*keys, F.timestamp_micros("at").alias("ts"), F.from_json("body", shape).alias("_row"))
    return rows.select(*keys, "ts", "_row.*").select(*alerts.columns)
