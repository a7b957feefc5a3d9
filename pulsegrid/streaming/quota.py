"""Token-bucket quota check over a request log, in batch and on a stream."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.functions.expressions import epoch_micros
from pulsegrid.operators import ordered
from pulsegrid.operators.transfer import Bucket, Map, chunk_map
from pulsegrid.session import materialize

CAPACITY = 20
RATE = 2.0
IDLE_MS = 300_000


def check(
    at: float, tokens: float | None, last: float, capacity: float, rate: float
) -> tuple[bool, int, float, float]:
    """The rule for one request: allowed, seconds to wait, tokens and time after it.

    A client's first request finds a full bucket.  A refused one changes nothing.
    """
    level = capacity if tokens is None else min(capacity, tokens + (at - last) * rate)
    if level >= 1:
        return True, 0, level - 1, at
    return False, int((1 - level) / rate) + 1, tokens, last


# Requests of a chunk, which one task reads in order.
CHUNK_ROWS = 4096
# Requests that a stream's task answers at a time.
BLOCK_ROWS = 65_536

_MAP_FIELDS = ["first_at", "last_at", "start", "level", "moves"]
_MAPS = "first_at long, last_at long, start array<long>, level array<long>, moves array<boolean>"


def _as_map(bucket: Bucket, part: dict) -> Map:
    return Map(bucket, np.array(part["start"], np.int64), np.array(part["level"], np.int64), np.array(part["moves"], bool))


def _batch(batch: pa.RecordBatch, keep: list[str], rows: list[int], more: dict[str, list]) -> pa.RecordBatch:
    """Some rows of ``keep`` with further columns."""
    kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
    kinds = {"start": pa.list_(pa.int64()), "level": pa.list_(pa.int64()), "moves": pa.list_(pa.bool_())}
    added = [pa.array(values, kinds.get(name, pa.int64())) for name, values in more.items()]
    return pa.RecordBatch.from_arrays([*kept, *added], names=[*keep, *more])


def _maps(found: list[tuple[int, int, Map]]) -> dict[str, list]:
    columns = [(first, last, m.start.tolist(), m.level.tolist(), m.moves.tolist()) for first, last, m in found]
    return dict(zip(_MAP_FIELDS, map(list, zip(*columns)))) if columns else {name: [] for name in _MAP_FIELDS}


def chunk_starts(times: DataFrame, client: str, bucket: Bucket) -> DataFrame:
    """(client, _cell, _since, _level): the level each chunk of ``(client, _cell, _at)`` starts from, and when it was that.

    Chunks are mapped; the maps of a day with several are composed; those of a client's days are read in
    order, then those within each such day.
    """
    kind = f"`{client}` {dict(times.dtypes)[client]}"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for listed in batch.column("times"):
                at = listed.values.to_numpy()
                found.append((int(at[0]), int(at[-1]), chunk_map(bucket, at)))
            yield _batch(batch, [client, "_cell", "_day"], list(range(len(found))), _maps(found))

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for parts in batch.column("parts").to_pylist():
                whole, last = None, None
                for part in parts:
                    one = _as_map(bucket, part)
                    whole = one if whole is None else whole.refilled(bucket.gained(part["first_at"] - last)).then(one)
                    last = part["last_at"]
                found.append((parts[0]["first_at"], last, whole))
            yield _batch(batch, [client, "_day"], list(range(len(found))), _maps(found))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], {"_place": [], "_since": [], "_level": []}
            since, levels = batch.column("_since").to_pylist(), batch.column("_level").to_pylist()
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                before, level = since[i], bucket.capacity if levels[i] is None else levels[i]
                for part in parts:
                    if before is not None:
                        level = min(bucket.capacity, level + bucket.gained(part["first_at"] - before))
                    rows.append(i)
                    for name, value in zip(out, (part["place"], part["first_at"], level)):
                        out[name].append(value)
                    level, before = _as_map(bucket, part)(level), part["last_at"]
            yield _batch(batch, [client], rows, out)

    def listed(maps: DataFrame, by: list[str], place: str) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct(*_MAP_FIELDS, F.col(place).alias("place"))))
        return maps.groupBy(*by).agg(parts.alias("parts"))

    nothing = [F.lit(None).cast("long").alias(c) for c in ("_since", "_level")]
    placed = f"{kind}, _place long, _since long, _level long"
    # mapping is work for the processor, not for the shuffle, so its tasks are not merged by size
    dealt = times.repartition(int(times.sparkSession.conf.get("spark.sql.shuffle.partitions")), client, "_cell")
    chunks = dealt.groupBy(client, "_cell").agg(F.sort_array(F.collect_list("_at")).alias("times"))
    chunks = chunks.withColumn("_day", ordered.day_of_cell()).mapInArrow(mapped, f"{kind}, _cell long, _day long, {_MAPS}")
    chunks = materialize(chunks, "quota-maps")
    days = listed(chunks, [client, "_day"], "_cell")
    several = days.where(F.size("parts") > 1)
    single = days.where(F.size("parts") == 1)
    alone = single.select(client, "_day", F.col("parts")[0].alias("p")).select(client, "_day", *[f"p.{c}" for c in _MAP_FIELDS])
    whole = alone.unionByName(several.mapInArrow(composed, f"{kind}, _day long, {_MAPS}"))
    of_days = listed(whole, [client], "_day").select(client, "parts", *nothing).mapInArrow(read, placed)
    of_days = materialize(of_days.withColumnRenamed("_place", "_day"), "quota-days")
    inside = ordered.join_nullsafe(several, of_days, [client, "_day"]).select(client, "parts", "_since", "_level")
    of_chunks = inside.mapInArrow(read, placed).withColumnRenamed("_place", "_cell")
    cells = single.select(client, "_day", F.col("parts")[0]["place"].alias("_cell"))
    return ordered.join_nullsafe(cells, of_days, [client, "_day"]).drop("_day").unionByName(of_chunks)


def busy_clients(requests: DataFrame, client: str, rows: int) -> DataFrame:
    """(_key, _busy) of the clients with more than ``rows`` requests; at most one for so many of the input."""
    counts = requests.groupBy(F.struct(client).alias("_key")).count()
    return counts.where(F.col("count") > rows).select("_key", F.lit(True).alias("_busy"))


def token_bucket(
    requests: DataFrame, client: str, order: list[str], capacity: int = CAPACITY, rate: float = RATE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``allowed`` and ``retry_after`` (seconds) to every request.

    A client's first request finds a full bucket; a refused one changes nothing.  Decisions depend on all
    before them, so a client with up to ``chunk_rows`` requests in all is read in order, in one pass.  For the
    others, what a chunk of requests does to the bucket is a map from levels to levels
    (``operators.transfer``).  Chunks of about ``chunk_rows`` requests, by counts per client and second, are
    mapped in parallel, the maps give the level every chunk starts from, and all chunks decide in parallel.  So
    a client that never pauses is spread like any other: no task holds more than a chunk, the maps of one
    day, or one map a day.

    Levels are exact.  Requests without a time get null in both columns.
    """
    ts, bucket, names = order[0], Bucket.of(capacity, rate), requests.columns
    timed = requests.where(F.col(ts).isNotNull())
    busy = materialize(busy_clients(timed, client, chunk_rows), "busy-clients")
    rows = timed.withColumn("_cell", F.lit(0).cast("long"))
    starts = None
    if not busy.isEmpty():
        marked = timed.withColumn("_key", F.struct(client)).join(ordered.checked_broadcast(busy), "_key", "left")
        rows = marked.where("_busy is null").select(*names, F.lit(0).cast("long").alias("_cell"))
        celled = ordered.with_counted_cells(marked.where("_busy").select(*names), [client], ts, chunk_rows)
        times = celled.select(client, "_cell", epoch_micros(F.col(ts)).alias("_at"))
        starts = materialize(chunk_starts(times, client, bucket), "quota-starts")
        rows = rows.unionByName(celled.select(*names, "_cell"))
    # a chunk's start stands before its rows, so that one sorted pass meets it first
    zero = F.lit(0).cast("long")
    both = rows.withColumns({"_at": epoch_micros(F.col(ts)), "_since": zero, "_level": zero, "_row": F.lit(True)})
    if starts is not None:
        marks = starts.withColumns({"_at": zero, "_row": F.lit(False)})
        both = both.unionByName(marks, allowMissingColumns=True)
    placed = both.repartition(client, "_cell").sortWithinPartitions(client, "_cell", "_row", *order)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, since, open_chunk = bucket.capacity, 0, None
        for batch in batches:
            is_row = batch.column("_row")
            allowed, wait = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int32)
            read = (batch.column(c).to_pylist() for c in (client, "_cell", "_row", "_at", "_level", "_since"))
            for i, (who, cell, row, at, start, before) in enumerate(zip(*read)):
                if not row:
                    level, since, open_chunk = start, before, (who, cell)
                    continue
                if open_chunk != (who, cell):  # all of a client's requests, from a full bucket
                    level, since, open_chunk = bucket.capacity, at, (who, cell)
                allowed[i], wait[i], level = bucket.decide(min(bucket.capacity, level + bucket.gained(at - since)))
                since = at
            columns = [*(batch.column(c) for c in names), pa.array(allowed), pa.array(wait)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "allowed", "retry_after"]).filter(is_row)

    fields = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes)
    decided = placed.mapInArrow(decide, f"{fields}, allowed boolean, retry_after int")
    untimed = requests.where(F.col(ts).isNull())
    nothing = {"allowed": F.lit(None).cast("boolean"), "retry_after": F.lit(None).cast("int")}
    return decided.unionByName(untimed.withColumns(nothing))


def stream_token_bucket(
    requests: DataFrame, client: str, capacity: int = CAPACITY, rate: float = RATE, late: str = "10 minutes"
) -> DataFrame:
    """The same rule on a stream: ``(client, ts, allowed, retry_after)``.

    Requests are answered once the watermark has passed them, so late ones take their place and neither
    the batches nor the order of arrival within the lateness change an answer.  Requests without a time
    get null in both columns.

    A client is one task in a batch, and the times it holds are one state row, as compressed steps.  The task takes
    one step for each allowed request and one for each run of refused ones.
    """
    bucket = Bucket.of(capacity, rate)
    # an idle client is forgotten once its bucket is full again
    idle_ms = max(IDLE_MS, -(-bucket.full_after // 1000))
    columns = [client, "at", "allowed", "retry_after"]

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, level, since = state.get if state.exists else (None, None, None)
        times = [] if held is None else [np.cumsum(np.frombuffer(zlib.decompress(held), np.int64))]
        if not state.hasTimedOut:
            times += [pdf["at"].to_numpy(np.int64, copy=True) for pdf in batches]
        at, passed_ms, found = np.concatenate(times or [np.empty(0, np.int64)]), state.getCurrentWatermarkMs(), []
        times.clear()
        at.sort()
        now, later = np.split(at, [np.searchsorted(at, passed_ms * 1000)])
        for i in range(0, len(now), BLOCK_ROWS):
            block = now[i : i + BLOCK_ROWS]
            if level is None:
                level, since = bucket.capacity, int(block[0])
            allowed, wait, level = bucket.decide_all(level, since, block)
            since = int(block[-1])
            found.append((block, allowed, wait))
        if len(later):
            look = int(later[0]) // 1000
        elif level is not None:
            look = since // 1000 + idle_ms
            level, since = (None, None) if look < passed_ms else (level, since)
        if level is None and not len(later):
            state.remove()
        else:
            state.update((zlib.compress(np.diff(later, prepend=0), 1), level, since))
            state.setTimeoutTimestamp(max(look, passed_ms + 1))
        for block, *answers in found:
            yield pd.DataFrame(dict(zip(columns, ([key[0]] * len(block), block, *answers))))

    marked = requests.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    timed = marked.select(client, "ts", epoch_micros(F.col("ts")).alias("at"))
    answered = timed.groupBy(client).applyInPandasWithState(
        answer, f"`{client}` {dict(requests.dtypes)[client]}, at bigint, allowed boolean, retry_after int",
        "held binary, level bigint, since bigint", "append", GroupStateTimeout.EventTimeTimeout,
    )
    none = [F.lit(None).cast("boolean").alias("allowed"), F.lit(None).cast("int").alias("retry_after")]
    untimed = requests.where(F.col("ts").isNull()).select(client, "ts", *none)
    return answered.select(client, F.timestamp_micros("at").alias("ts"), "allowed", "retry_after").unionByName(untimed)
