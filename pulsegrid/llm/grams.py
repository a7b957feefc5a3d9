"""Exact numbers for words, lines and word sequences of the texts of a batch.

Numbers come from dictionaries and ranks, not from hashes, so two of them are equal
only if what they stand for is equal.  They hold within one batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, gaps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges one after the other, ``gaps[i]`` spaces (0 or 1) after range ``i``, and ``len + 1`` offsets."""
    sizes = ends - starts
    if gaps is not None:
        sizes = sizes + gaps
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.concatenate((data, np.zeros(1, np.uint8)))[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])]
    if gaps is not None:
        out[at[1:][gaps > 0] - 1] = 32
    return out, at


def range_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number from 0 for each byte range, equal for equal bytes only."""
    if not len(starts):
        return np.zeros(0, np.int64)
    kept, at = gathered(data, starts, ends)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Grams:
    """Sequences of ``length`` words ending at some words: the words they end at, in order, and a number for each.

    ``earlier`` is the distance to the nearest equal sequence before it in the same
    text, 0 if there is none; ``repeated`` tells whether the text has it twice.
    """

    def __init__(self, at: np.ndarray, key: np.ndarray, begin: np.ndarray, length: int):
        order = np.argsort(key, kind="stable")
        keys, places = key[order], at[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
        same = ~new & np.concatenate(([False], begin[places[1:]] == begin[places[:-1]])) if len(keys) else new
        self.at, self.length, self.begin = at, length, begin
        self.number, self.earlier = np.empty(len(at), np.int64), np.zeros(len(at), np.int64)
        self.repeated = np.zeros(len(at), bool)
        self.number[order] = np.cumsum(new) - 1
        self.earlier[order[same]] = (places[1:] - places[:-1])[same[1:]] if len(keys) else 0
        self.repeated[order] = same | np.concatenate((same[1:], [False])) if len(keys) else same

    def longer(self, by: int) -> Grams:
        """The sequences longer by ``by <= length`` words, of those whose parts are both repeated in their text."""
        known = np.full(len(self.begin), -1, np.int64)
        known[self.at[self.repeated]] = self.number[self.repeated]
        ends = self.at[self.repeated]
        ends = ends[ends - by - self.length + 1 >= self.begin[ends]]
        left = known[ends - by]
        ends, left = ends[left >= 0], left[left >= 0]
        return Grams(ends, left * (len(known) + 1) + known[ends], self.begin, self.length + by)


def pairs(ids: np.ndarray, first: np.ndarray) -> Grams:
    """Sequences of two words.  ``first`` is the number of each text's first word (``len + 1``)."""
    begin = np.repeat(first[:-1], np.diff(first))
    ends = np.flatnonzero(np.arange(len(ids)) > begin)
    largest = int(ids.max()) + 1 if len(ids) else 1
    return Grams(ends, ids[ends - 1] * largest + ids[ends], begin, 2)
