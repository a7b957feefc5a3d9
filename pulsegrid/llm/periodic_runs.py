"""Stretches of words that repeat themselves: a sparse dynamic programme over diagonals.

Words are read from left to right.  An earlier occurrence of what ends at a word, at a
distance ``d``, adds one to the match length of the diagonal of lag ``d``; a diagonal that
the next word does not extend has ended, and a matched part of ``m`` words is a run of
``m + d`` words with period ``d`` if that is long enough.

A word alone has too many earlier occurrences: a text of one repeated word would have all
pairs.  A run of period ``d`` has at least ``3 d`` matched words, so a diagonal counts only
once ``L`` words match, ``L`` the largest power of two up to ``3 d`` (4 for the lags 1 and 2).
Of the earlier occurrences of those ``L`` words within ``L`` words only the nearest matters:
its distance ``p`` divides the distance ``d`` of any other (both are periods of at least
``p + d`` words), and then the words around repeat with ``p`` already.  So each word touches
one diagonal a length at most, words without a repeated sequence touch none, every run has
one diagonal, and its lag is its smallest period.  No lag or text length is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm import grams as g
from pulsegrid.llm import textkernels as tk

# A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

_RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def ended_diagonals(found: g.Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs whose lag belongs to this sequence length, as (start, length, period)."""
    size = found.length
    low, high = (1 if size == 4 else -(-size // 3)), (2 * size - 1) // 3
    hit = (found.earlier >= low) & (found.earlier <= high)
    at, lag = found.at[hit], found.earlier[hit]
    if not len(at):
        return at, at, at
    # a word extends a diagonal if the word before it was on the same one
    opens = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])))
    head = np.flatnonzero(opens)
    period, matched = lag[head], np.diff(np.concatenate((head, [len(at)]))) - 1 + size
    length = matched + period
    enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    start = at[head] - size + 1 - period
    return start[enough], length[enough], period[enough]


def find_runs(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of several texts by start, then period: word numbers over all texts, lengths, periods.

    ``ids`` are the words' numbers, ``first`` the number of each text's first word (``len + 1``).
    """
    found, parts = g.pairs(ids, first), []
    while found.repeated.any():
        found = found.longer(found.length)
        parts.append(ended_diagonals(found))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(column) for column in zip(*parts))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in tk.text_slices(whole, "text"):
            data, offsets = tk.column_bytes(batch.column("text"))
            starts, ends, first = tk.words(data, offsets)
            start, length, period = find_runs(g.range_ids(data, starts, ends), first)
            change = np.zeros(len(starts) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            upto = np.searchsorted(kept, first)
            gaps = np.ones(len(kept), np.int64)
            gaps[upto[1:][np.diff(upto) > 0] - 1] = 0
            text, at = g.gathered(data, starts[kept], ends[kept], gaps)
            collapsed = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(at[upto].astype(np.int64)), pa.py_buffer(text))
            listed = pa.StructArray.from_arrays(
                [pa.array(start - first[np.searchsorted(first, start, side="right") - 1]), pa.array(length), pa.array(period)],
                names=["start", "length", "period"],
            )
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, first).astype(np.int32)), listed)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first)), runs, collapsed.cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``runs`` by start, then period, and the ``collapsed`` text.

    A run (start and length in words, from 0) is a stretch with smallest period ``period`` and at
    least ``max(6, 4 * period)`` words that no neighbouring word extends.  The collapsed text has the
    words, joined by one space, that no run contains after its first ``period`` words.  Words lie
    between spaces and the characters 0x09 to 0x0D.

    One pass without a shuffle; texts are read whole.  Null, empty and blank texts have no words,
    no runs and '' as collapsed text.  Repeated rows are kept; a null id stays null; other columns
    are ignored; an empty table gives no rows.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(_detect, _RUNS).withColumnRenamed("doc_id", id_col)
