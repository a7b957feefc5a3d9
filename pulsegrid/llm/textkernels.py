"""Vectorised text work on Arrow batches: bytes, words and shingle sets.

Every kernel takes the UTF-8 bytes of several texts in one array and the offsets of
the texts in it.  Null texts are empty.  ``text_slices`` bounds how many bytes are
worked on at once, so memory does not grow with the batch; a single text longer than
the bound is worked on alone and whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at once.
SLICE_BYTES = 2_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; kept for the life of the worker up to ``SLICE_BYTES``."""
    kept = _powers.get(int(base))
    if kept is None or len(kept) < n:
        steps = np.full(max(n, SLICE_BYTES + 64 if n <= SLICE_BYTES + 64 else n), base, dtype=np.uint64)
        steps[0] = 1
        kept = np.multiply.accumulate(steps)
        if n <= SLICE_BYTES + 64:
            _powers[int(base)] = kept
    return kept[:n]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the ``len + 1`` offsets of its texts, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=column.offset + len(column) + 1)[column.offset :]
    if buffers[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text, or one row."""
    _, offsets = column_bytes(batch.column(column))
    start, rows = 0, batch.num_rows
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield batch.slice(start, end - start)
        start = end


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal for equal content wherever it stands."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    raw = (total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts]
    return mix(raw ^ (ends - starts).astype(np.uint64) << np.uint64(48))


def sequence_hashes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each sequence ``hashes[bounds[i]:bounds[i + 1]]``, equal for equal sequences wherever they stand."""
    n = len(hashes)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(hashes, 13) * powers(_BASE, n), out=total[1:])
    raw = (total[bounds[1:]] - total[bounds[:-1]]) * powers(_INVERSE, n + 1)[bounds[:-1]]
    return mix(raw ^ np.diff(bounds).astype(np.uint64), 14)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def is_space(data: np.ndarray) -> np.ndarray:
    """The separators of words: space and 0x09 to 0x0D."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def is_word(data: np.ndarray) -> np.ndarray:
    """ASCII letters and digits, and every byte of other characters."""
    folded = data | 32
    return ((folded >= 97) & (folded <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128)


def words(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of the first word in it (``len + 1``).

    ``inside`` marks the bytes of words; by default all but separators.
    """
    n = len(data)
    inside = ~is_space(data) if inside is None else inside
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:n] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if n else starts
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes, and ``len + 1`` offsets into them.

    Words are lower-cased (A-Z).  A text with fewer than ``k`` words but at least one
    has its whole word sequence as the only shingle; a text without words has none.
    """
    starts, ends, first = words(data, offsets)
    h = range_hashes(lower_ascii(data), starts, ends)
    texts, counts = len(offsets) - 1, np.diff(first)
    of_word = np.repeat(np.arange(texts), counts)
    grams = np.zeros(len(h), dtype=np.uint64)
    full = np.arange(len(h)) + k <= first[1:][of_word] if len(h) else np.zeros(0, bool)
    for j in range(min(k, len(h))):
        grams[: len(h) - j] = mix(grams[: len(h) - j] * _BASE + h[j:], 1)
    chosen, owner = grams[full], of_word[full]
    for short in range(1, k):  # texts of fewer words than a shingle
        at = np.flatnonzero(counts == short)
        if len(at):
            value = np.full(len(at), np.uint64(short))
            for j in range(short):
                value = mix(value * _BASE + h[first[:-1][at] + j], 2)
            chosen, owner = np.concatenate((chosen, value)), np.concatenate((owner, at))
    if len(chosen) and np.any(np.diff(owner) < 0):
        order = np.argsort(owner, kind="stable")
        chosen, owner = chosen[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            chosen[a:b].sort()
    new = np.ones(len(chosen), dtype=bool)
    if len(chosen) > 1:
        new[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    chosen, owner = chosen[new], owner[new]
    return chosen, np.searchsorted(owner, np.arange(texts + 1))


def reduce_ranges(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``ufunc.reduce`` of each range ``bounds[i]:bounds[i + 1]``; 0 where a range is empty."""
    out = np.zeros(len(bounds) - 1, dtype=values.dtype)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = ufunc.reduceat(values, bounds[:-1][some])
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys``, one table each.  The input is sorted by them; no key is null."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows, dtype=bool)
        for name in keys:
            values = batch.column(name).to_numpy(zero_copy_only=False)
            changed[1:] |= values[1:] != values[:-1]
            if held:
                changed[0] |= held[-1].column(name)[-1].as_py() != values[0].item()
        start = 0
        for at in np.flatnonzero(changed).tolist():
            if at > start:
                held.append(batch.slice(start, at - start))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, start = [], at
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
