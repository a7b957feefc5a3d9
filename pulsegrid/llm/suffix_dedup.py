"""Removing repeated byte strings by suffix sorting.

Every window of ``length`` bytes that also starts earlier (smaller id, or earlier in the
same text) is covered.  To sort only suffixes that can matter, and in shards:

1. Each window start belongs to the k-gram of smallest hash inside its window (its
   anchor).  Equal windows have equal anchors at the same distance, so a run of window
   starts with one anchor, the anchor in one half of them, is a segment.  Its key is the
   hash of the bytes that all those windows share with the anchor, and windows are equal
   only between segments of one key.
2. Segments of one key and equal bytes are one class.  All but its first
   occurrence are repeats.  Classes alone under their key need no more work.
3. First occurrences of classes that share a key are sorted: shards of whole keys
   go through induced suffix sorting; equal windows are neighbours whose common prefix
   reaches ``length``, and all but the earliest are repeats.
4. A key with very many classes (text around a common passage) is cut further by
   window, so that no task holds it whole.

Bytes travel only for the segments of step 3.  Class and window identities are 128 bits
of hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import textkernels as tk
from pulsegrid.llm.induced_sort import sort_suffixes
from pulsegrid.llm.phases import phase

LENGTH = 100
GRAM = 16
# Bytes of a shard that is sorted at once, and classes of an anchor from which on its windows are dealt out.
SHARD_BYTES = 1_000_000
# Bytes of text worked on at once: about a dozen arrays of eight times as much.
SLICE_BYTES = 250_000
MANY_CLASSES = 2000

_SEGMENTS = "doc long, lo int, n int, h1 long, h2 long"
_SPANS = "doc long, lo int, hi int"


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefixes and suffixes."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of window starts with one anchor: text number, first start, count, key, identity."""
    n = len(data)
    if n < length:
        return {x: np.zeros(0, np.int64) for x in ("text", "lo", "n", "h1", "h2")}
    starts = np.arange(n - gram + 1)
    grams = tk.range_hashes(data, starts, starts + gram)
    bits = np.uint64(max(n, 1).bit_length())
    packed = grams >> bits << bits | starts.astype(np.uint64)
    anchor = (_sliding_min(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    inside = np.arange(len(anchor)) + length <= offsets[1:][text]
    at = np.flatnonzero(inside)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo = at[first]
    count = np.diff(np.append(first, len(at)))
    # Windows with the anchor in their first half all contain the bytes after it, the others those before it: with
    # these the key of a segment covers more than half a window, and chance meetings of short k-grams are rare.
    half, pos = (length - gram) // 2, anchor[lo]
    split = np.clip(pos - half, lo, lo + count)
    parts = []
    for a, b, low, high in ((lo, split, -half - 1, gram), (split, lo + count, 0, length - half)):
        some = a < b
        key = tk.range_hashes(data, pos[some] + low, pos[some] + high)
        parts.append((a[some], b[some] - a[some], pos[some], tk.mix(key, 34 + int(low == 0))))
    lo, count, pos, key = (np.concatenate(x) for x in zip(*parts))
    own = text[lo]
    whole = tk.mix(tk.range_hashes(data, lo, lo + count + length - 1), 31) ^ tk.mix((pos - lo).astype(np.uint64), 32)
    return {"text": own, "lo": lo - offsets[own], "n": count, "h1": key, "h2": whole}


def _find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.text_slices(whole, "text", SLICE_BYTES):
            found = segments(*tk.column_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(found["text"]))]
                + [pa.array(found[x].astype(np.int32)) for x in ("lo", "n")]
                + [pa.array(found[x].astype(np.uint64).view(np.int64)) for x in ("h1", "h2")],
                names=["doc", "lo", "n", "h1", "h2"],
            )


def _cut_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed segments of each text; of keys with very many classes the windows' hashes."""
    for whole in batches:
        for batch in tk.text_slices(whole, "text", SLICE_BYTES):
            data, offsets = tk.column_bytes(batch.column("text"))
            listed = batch.column("parts")
            parts = listed.flatten()
            row = np.repeat(np.arange(batch.num_rows), np.diff(listed.offsets.to_numpy()))
            h1, lo, n, many = (parts.field(x).to_numpy(zero_copy_only=False) for x in ("h1", "lo", "n", "many"))
            start = offsets[row] + lo
            few = np.flatnonzero(~many)
            size = n[few].astype(np.int64) + LENGTH - 1
            at = np.concatenate(([0], np.cumsum(size)))
            raw = data[np.repeat(start[few] - at[:-1], size) + np.arange(at[-1])]
            cut = pa.Array.from_buffers(pa.binary(), len(few), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
            none = pa.nulls(len(few), pa.int64())
            doc = batch.column("doc")
            names = ["h1", "doc", "lo", "n", "bytes", "w1", "w2"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[few]), doc.take(pa.array(row[few])), pa.array(lo[few]), pa.array(n[few]), cut, none, none], names=names)
            dealt = np.flatnonzero(many)
            if len(dealt):
                count = n[dealt].astype(np.int64)
                upto = np.concatenate(([0], np.cumsum(count)))
                step = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
                of = np.repeat(dealt, count)
                begin = start[of] + step
                back = len(data) - begin
                hashes = [tk.range_hashes(data, begin, begin + LENGTH), tk.mix(tk.range_hashes(data[::-1], back - LENGTH, back), 33)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1[of]), doc.take(pa.array(row[of])), pa.array((lo[of] + step).astype(np.int32)),
                     pa.array(np.ones(len(of), np.int32)), pa.nulls(len(of), pa.binary()), *(pa.array(h.view(np.int64)) for h in hashes)],
                    names=names)


def _sort_shard(parts: list[pa.Table]) -> pa.RecordBatch:
    """Windows of a shard that start earlier in another of its segments, as spans."""
    rows = pa.concat_tables(parts).combine_chunks()
    doc, lo, n = (rows.column(x).to_numpy().astype(np.int64) for x in ("doc", "lo", "n"))
    raw = [x.as_py() for x in rows.column("bytes")]
    sizes = np.array([len(x) + 1 for x in raw])
    at = np.concatenate(([0], np.cumsum(sizes)))
    text = np.zeros(at[-1], dtype=np.int64)
    for a, x in zip(at.tolist(), raw):
        text[a : a + len(x)] = np.frombuffer(x, dtype=np.uint8).astype(np.int64) + 1
    order, common = sort_suffixes(text, LENGTH)
    group = np.cumsum(common < LENGTH)
    segment = np.repeat(np.arange(len(raw)), sizes)[order]
    inner = order - at[segment]
    window = inner < n[segment]
    group, segment, start = group[window], segment[window], (lo[segment] + inner)[window]
    owner = doc[segment]
    by = np.lexsort((start, owner, group))
    repeat = np.zeros(len(by), dtype=bool)
    repeat[1:] = group[by][1:] == group[by][:-1]
    owner, start = owner[by][repeat], start[by][repeat]
    by = np.lexsort((start, owner))
    owner, start = owner[by], start[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(by)) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(owner[first]), pa.array(start[first].astype(np.int32)), pa.array((start[last] + LENGTH).astype(np.int32) if len(by) else np.zeros(0, np.int32))],
        names=["doc", "lo", "hi"],
    )


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for rows in tk.runs(batches, ["h1"]):
        held.append(rows)
        size += rows.column("bytes").nbytes
        if size >= SHARD_BYTES:
            yield _sort_shard(held)
            held, size = [], 0
    if held:
        yield _sort_shard(held)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.text_slices(whole, "text"):
            data, offsets = tk.column_bytes(batch.column("text"))
            rows = []
            for row in range(batch.num_rows):
                own = data[offsets[row] : offsets[row + 1]]
                listed = batch.column("spans")[row]
                if not listed.is_valid:
                    rows.append((len(own), 0, 0, hashlib.sha256(own.tobytes()).hexdigest()))
                    continue
                spans = listed.values
                change = np.zeros(len(own) + 1, dtype=np.int32)
                np.add.at(change, spans.field("lo").to_numpy(), 1)
                np.add.at(change, spans.field("hi").to_numpy(), -1)
                gone = np.cumsum(change[:-1]) > 0
                runs = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[0])
                rows.append((len(own), int(gone.sum()), runs, hashlib.sha256(own[~gone].tobytes()).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lo, hi): byte ranges covered by windows that start earlier; ranges of a text may overlap."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    found = phase(given.mapInArrow(_find_segments, _SEGMENTS), "segments", small_batches=True)
    twice = found.groupBy("h1").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1")
    found = phase(found.join(twice, "h1"), "joint-segments")

    first = F.min(F.struct("doc", "lo", "n")).alias("first")
    classes = phase(found.groupBy("h1", "h2").agg(first, F.count(F.lit(1)).alias("c")), "segment-classes")
    later = found.join(classes.where("c > 1").select("h1", "h2", "first"), ["h1", "h2"])
    later = later.where((F.col("doc") != F.col("first.doc")) | (F.col("lo") != F.col("first.lo")))
    later = later.select("doc", "lo", (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("hi"))

    shared = classes.groupBy("h1").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    shared = shared.select("h1", (F.col("classes") > MANY_CLASSES).alias("many"))
    parts = classes.join(shared, "h1").select("first.doc", F.struct("h1", "first.lo", "first.n", "many").alias("part"))
    listed = parts.groupBy("doc").agg(F.collect_list("part").alias("parts"))
    cut_schema = "h1 long, doc long, lo int, n int, bytes binary, w1 long, w2 long"
    cut = phase(given.join(listed, "doc").mapInArrow(_cut_bytes, cut_schema), "segment-bytes", small_batches=True)
    dealt = cut.where("bytes is not null").select("h1", "doc", "lo", "n", "bytes")
    sorted_ = dealt.repartition("h1").sortWithinPartitions("h1").mapInArrow(_sort_shards, _SPANS)

    windows = cut.where("w1 is not null").select("w1", "w2", F.struct("doc", "lo").alias("at"))
    earliest = windows.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    apart = windows.join(earliest, ["w1", "w2"]).where("at != first")
    apart = apart.select("at.doc", "at.lo", (F.col("at.lo") + LENGTH).alias("hi"))
    return later.unionByName(sorted_).unionByName(apart)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Null and empty texts have 0 bytes and the digest of nothing.  Ids order the texts and
    should be unique: rows that repeat an id and its text get one result each, the same.
    Texts with a null id are left whole and cover nothing.  Other columns are ignored; an
    empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, id_col, text_col).distinct()
    listed = phase(spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")
    out = given.join(listed, "doc", "left").mapInArrow(
        _remove, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("doc", id_col)
