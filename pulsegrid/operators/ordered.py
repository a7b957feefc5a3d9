"""Order-dependent work on series of any length, without one task per series.

A plain ``Window.partitionBy(series).orderBy(ts)`` puts a whole series into one
task.  That is right for calendar-bounded input (hourly means: at most 24 rows a
day), and wrong for raw points, where one series may hold a large share of all
rows.  The operators here first cut every series into time cells:

* a window per (series, cell) orders the rows of one cell,
* one summary row per (series, cell), of which there are as many as the calendar
  has cells, carries counts, sums or last rows from cell to cell,
* the summaries join back on (series, cell), which is the partitioning the cell
  window already has.

Results equal the plain window's.  Choose the cell so that the densest series has
a task-sized number of rows in it; ``densest_cell`` measures that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.functions.expressions import epoch_micros, floor_div, null_safe_equal
from pulsegrid.session import materialize

CELL_SECONDS = 3600
# Longest row frame and the default block length of ``with_blocks``.
BLOCK_ROWS = 100_000
# Rows of a small side, and bytes of them as JSON text, that may be broadcast after counting them.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
# Sub-groups per key in two-step top-n.
SALTS = 32


def time_cell(ts: str, seconds: int) -> Column:
    """Number of the time cell; rows without a time come first, in a cell of their own."""
    cell = floor_div(epoch_micros(F.col(ts)), seconds * 1_000_000)
    return F.coalesce(cell, F.lit(-(2**62)).cast("bigint"))


def with_cells(df: DataFrame, keys: list[str], ts: str, seconds: int = CELL_SECONDS) -> DataFrame:
    """Add ``_key`` (the series as a struct) and ``_cell``, once for chained operators.

    Windows and joins below all use these two columns, so the rows are shuffled
    once.  Structs compare equal when their null fields match, which keeps rows
    with a null key without a null-safe join (whose rewritten keys would need a
    shuffle of their own).
    """
    if "_cell" in df.columns:
        return df
    return df.withColumns({"_key": F.struct(*keys), "_cell": time_cell(ts, seconds)})


# Cells by count: rows of a cell, microseconds of the slots they are cut at, and how many cells a day may have.
CELL_ROWS, SLOT_MICROS, CELLS_A_DAY = 100_000, 1_000_000, 1 << 17
DAY_MICROS = 86_400_000_000


def day_of_cell() -> Column:
    """Number of the day of a cell of ``with_counted_cells``."""
    return floor_div(F.col("_cell"), CELLS_A_DAY)


def dense_days(df: DataFrame, keys: list[str], ts: str, rows: int = CELL_ROWS) -> DataFrame:
    """(_key, _day, _cuts): for the days of a series with more than ``rows`` rows, the slots at which new cells begin.

    Rows are counted per slot before they are shuffled; a slot begins a cell when the rows before it in the
    day pass a multiple of ``rows``.  A day that is listed has over ``rows`` rows, so the table has at most
    one row for so many of the input.
    """
    at = epoch_micros(F.col(ts))
    slots = df.where(F.col(ts).isNotNull()).groupBy(
        F.struct(*keys).alias("_key"), floor_div(at, DAY_MICROS).alias("_day"), floor_div(at, SLOT_MICROS).alias("_slot")
    ).agg(F.count(F.lit(1)).alias("_rows"))
    hour = Window.partitionBy("_key", "_day")
    before = F.sum("_rows").over(hour.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = slots.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_rows").over(hour)}).where(F.col("_all") > rows)
    part = F.floor(F.col("_before") / rows)
    begins = placed.withColumn("_new", part > F.lag(part).over(hour.orderBy("_slot")))
    return begins.groupBy("_key", "_day").agg(F.array_sort(F.collect_list(F.when(F.col("_new"), F.col("_slot")))).alias("_cuts"))


def with_counted_cells(df: DataFrame, keys: list[str], ts: str, rows: int = CELL_ROWS) -> DataFrame:
    """``with_cells`` with cells of a day, cut further where a day of a series has more than ``rows`` rows.

    A cell then has fewer than ``rows`` rows and those of one slot (a second).  Operators that find the columns
    ``_key`` and ``_cell`` use them.  Takes a second scan of keys and times, reduced to counts before its shuffle.
    """
    at = epoch_micros(F.col(ts))
    hour = F.coalesce(floor_div(at, DAY_MICROS), F.lit(-(2**44)).cast("bigint"))
    placed = df.withColumns({"_key": F.struct(*keys), "_day": hour})
    cuts = checked_broadcast(materialize(dense_days(df, keys, ts, rows), "dense-days"))
    slot = floor_div(at, SLOT_MICROS)
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut <= slot)))
    joined = placed.join(cuts, ["_key", "_day"], "left").withColumn("_cell", F.col("_day") * CELLS_A_DAY + part)
    return joined.select(*df.columns, "_key", "_cell")


def densest_cell(df: DataFrame, keys: list[str], ts: str, seconds: int = CELL_SECONDS) -> int:
    """Rows in the fullest (series, cell): the size of the largest window partition."""
    counts = df.groupBy(*keys, time_cell(ts, seconds).alias("_cell")).count()
    return counts.agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


def join_nullsafe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that matches null keys, keeping one copy of the key columns."""
    joined = left.alias("l").join(right.alias("r"), null_safe_equal("l", "r", on), how)
    extra = [F.col(f"r.{c}") for c in right.columns if c not in on]
    return joined.select("l.*", *extra)


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``small`` with a broadcast hint if its counted rows and bytes prove it small, else unchanged.

    For configuration-like inputs (rules, allow-lists), whose count is cheap.
    """
    width = F.octet_length(F.to_json(F.struct(*small.columns)))
    rows, size = small.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(small) if rows <= max_rows and size <= max_bytes else small


def salted_lookup(
    big: DataFrame, small: DataFrame, on: list[str], salt_from: list[str], salts: int = 16, how: str = "inner"
) -> DataFrame:
    """Join ``small`` (one row per key) to ``big``, spreading every key over ``salts`` tasks.

    The salt is a hash of row columns, so a recomputed task picks the same one.
    Adaptive execution still turns this into a broadcast when ``small`` is small.
    """
    if salts <= 1:
        return join_nullsafe(big, small, on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return join_nullsafe(salted, spread, [*on, "_salt"], how).drop("_salt")


def _ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


CELL = ["_key", "_cell"]


def _add_from_cells(local: DataFrame, summary: DataFrame, given: DataFrame) -> DataFrame:
    """Join the per-cell summary to the rows of its cell."""
    joined = local.join(summary, CELL)
    return joined if "_cell" in given.columns else joined.drop(*CELL)


def series_index(
    df: DataFrame, keys: list[str], order: list[str], seconds: int = CELL_SECONDS, total: str | None = None
) -> DataFrame:
    """Add ``rn``, the 0-based position in the series; ``order`` starts with the time column.

    With ``total`` also add the number of rows of the series under that name.
    """
    celled = with_cells(df, keys, order[0], seconds)
    cells = celled.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(_ordered(["_key"], ["_cell"]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select(
        *CELL,
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_key")).alias(total or "_total"),
    )
    local = celled.withColumn("_local", F.row_number().over(_ordered(CELL, order)))
    out = _add_from_cells(local, offsets, df)
    out = out.withColumn("rn", (F.col("_before") + F.col("_local") - 1).cast("bigint"))
    return out.drop("_local", "_before", "_total")


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], seconds: int = CELL_SECONDS
) -> DataFrame:
    """Add ``prev_<column>`` from the row before in the series (a lag of 1 across cells)."""
    celled = with_cells(df, keys, order[0], seconds)
    last = F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")
    cells = celled.groupBy(*CELL).agg(last)
    carried = cells.select(*CELL, F.lag("_last").over(_ordered(["_key"], ["_cell"])).alias("_carried"))
    within = F.lag(F.struct(*columns)).over(_ordered(CELL, order))
    joined = _add_from_cells(celled.withColumn("_within", within), carried, df)
    prev = F.coalesce(F.col("_within"), F.col("_carried"))
    return joined.withColumns({f"prev_{c}": prev[c] for c in columns}).drop("_within", "_carried")


def running_total(
    df: DataFrame, keys: list[str], order: list[str], column: str, name: str, seconds: int = CELL_SECONDS
) -> DataFrame:
    """Add ``name``, the running sum of ``column`` up to and including the row."""
    celled = with_cells(df, keys, order[0], seconds)
    cells = celled.groupBy(*CELL).agg(F.sum(column).alias("_sum"))
    before = F.sum("_sum").over(_ordered(["_key"], ["_cell"]).rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select(*CELL, F.coalesce(before, F.lit(0)).alias("_before"))
    frame = _ordered(CELL, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _add_from_cells(celled.withColumn("_local", F.sum(column).over(frame)), offsets, df)
    return out.withColumn(name, F.col("_before") + F.col("_local")).drop("_local", "_before")


def with_blocks(indexed: DataFrame, before: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Cut series with ``rn`` into equal blocks that overlap by ``before`` rows.

    Adds ``block`` and ``halo``.  A row frame of up to ``before`` preceding rows
    over (series, block) sees the same rows as over the series; drop rows with
    ``halo`` afterwards.
    """
    if before > block_rows:
        raise ValueError(f"a frame of {before} rows does not fit in blocks of {block_rows}")
    block = F.floor(F.col("rn") / block_rows).cast("bigint")
    in_tail = F.pmod(F.col("rn"), F.lit(block_rows)) >= block_rows - before
    targets = F.when(in_tail, F.array(block, block + 1)).otherwise(F.array(block))
    copies = indexed.withColumn("block", F.explode(targets))
    return copies.withColumn("halo", F.col("block") != block)


def top_n(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_from: list[str], salts: int = SALTS
) -> DataFrame:
    """The first ``n`` rows per key, with ``rank`` from 1.

    Step one keeps ``n`` rows per (key, salt), so a key with very many rows is
    ranked by many tasks; step two ranks at most ``n * salts`` rows per key.
    """
    out = df
    if salts > 1:
        salt = F.pmod(F.xxhash64(*salt_from), F.lit(salts)).cast("int")
        first = Window.partitionBy(*keys, "_salt").orderBy(*order)
        out = out.withColumn("_salt", salt).withColumn("rank", F.row_number().over(first))
        out = out.where(F.col("rank") <= n).drop("rank", "_salt")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
        F.col("rank") <= n
    )


def value_bucket(value: Column) -> Column:
    """A bucket number that never decreases with the value, about 4096 per factor e."""
    magnitude = F.floor((F.ln(F.abs(value)) + 750) * 4096).cast("bigint")
    return F.when(value > 0, magnitude).when(value < 0, -magnitude).when(value == 0, F.lit(0).cast("bigint"))


# Sub-buckets of a bucket of ``value_bucket``.
SUB_BUCKETS = 1 << 20


def value_part(value: Column) -> Column:
    """A number within the bucket that never decreases with the value: about ``SUB_BUCKETS`` per bucket.

    Buckets are a 4096th of their values wide, so a part is below 2.4e-10 of them: doubles offer about
    a million distinct values to each, however close together the values of a table lie.
    """
    size = F.abs(value)
    low = F.exp(F.floor((F.ln(size) + 750) * 4096) / 4096 - 750)
    inside = F.floor(F.coalesce(F.try_divide(size - low, low), F.lit(0.0)) * (4096 * SUB_BUCKETS)).cast("bigint")
    return F.when(value > 0, inside).when(value < 0, -inside).when(value == 0, F.lit(0).cast("bigint"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per key by counting, one column per name in ``probs``.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer.  Here values are counted per (key, bucket, part, value), which partial
    aggregation reduces and the shuffle spreads.  The counts of the buckets locate
    the wanted ranks, then those of the parts of these buckets, and only the parts
    that hold one are ordered by value; none has more than about a million.  Nulls
    and NaN are ignored.  Adds ``n``, the number of values.
    """
    counted = (
        df.where(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*keys, value_bucket(F.col(value)).alias("_bucket"), value_part(F.col(value)).alias("_part"), F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    parts = counted.groupBy(*keys, "_bucket", "_part").agg(F.sum("_rows").alias("_rows"))
    buckets = parts.groupBy(*keys, "_bucket").agg(F.sum("_rows").alias("_rows"))
    upto = F.sum("_rows").over(_ordered(keys, ["_bucket"]).rowsBetween(Window.unboundedPreceding, 0))
    located = buckets.select(
        *keys,
        "_bucket",
        (upto - F.col("_rows")).alias("_start"),
        upto.alias("_end"),
        F.sum("_rows").over(Window.partitionBy(*keys)).alias("n"),
    )
    names = list(probs)
    wanted = []
    for name in names:
        position = F.lit(float(probs[name])) * (F.col("n") - 1)
        wanted.append(F.struct(F.lit(name).alias("name"), F.floor(position).alias("rank"), F.lit(0).alias("upper")))
        wanted.append(F.struct(F.lit(name).alias("name"), F.ceil(position).alias("rank"), F.lit(1).alias("upper")))

    def held(ranks: Column) -> Column:
        return F.filter(ranks, lambda w: (w["rank"] >= F.col("_start")) & (w["rank"] < F.col("_end")))

    in_bucket = located.withColumn("_wanted", held(F.array(*wanted))).where(F.size("_wanted") > 0)
    place = [*keys, "_bucket"]
    parts = join_nullsafe(parts, in_bucket.select(*place, F.col("_start").alias("_before"), "n", "_wanted"), place)
    within = F.sum("_rows").over(_ordered(place, ["_part"]).rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.withColumn("_end", F.col("_before") + within).withColumn("_start", F.col("_end") - F.col("_rows"))
    in_part = parts.withColumn("_wanted", held(F.col("_wanted"))).where(F.size("_wanted") > 0)

    place = [*place, "_part"]
    values = join_nullsafe(counted, in_part.select(*place, "_start", "n", "_wanted"), place)
    frame = _ordered(place, ["_value"]).rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_upto", F.col("_start") + F.sum("_rows").over(frame))
    hits = values.select("*", F.explode("_wanted").alias("w")).where(
        (F.col("w.rank") < F.col("_upto")) & (F.col("w.rank") >= F.col("_upto") - F.col("_rows"))
    )
    picks = {}
    for name in names:
        for side in (0, 1):
            hit = (F.col("w.name") == name) & (F.col("w.upper") == side)
            picks[(name, side)] = F.max(F.when(hit, F.col("_value"))).alias(f"_{name}_{side}")
    found = hits.groupBy(*keys).agg(F.max("n").alias("n"), *picks.values())
    out = []
    for name in names:
        position = F.lit(float(probs[name])) * (F.col("n") - 1)
        low, high = F.col(f"_{name}_0"), F.col(f"_{name}_1")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*keys, "n", *out)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Append frames with the same columns."""
    return reduce(lambda a, b: a.unionByName(b), frames)
