"""Suffix sorting of one shard by induction, with common-prefix values.

The leftmost smaller suffixes (LMS) are sorted first: their substrings are ordered by a
first induction, named, and the string of names is sorted by doubling.  A second
induction from them orders all suffixes.  Both inductions are priority queues over the
first byte: buckets of (position, common prefix with the one before) that are filled in
order and drained byte by byte; a queue over its memory bound spills to a temporary
file.  All steps are array operations on whole buckets.

Suffixes are ordered by their first ``depth`` bytes at least, and common prefixes are
exact up to that length; this is all the caller needs to find equal windows.
"""

from __future__ import annotations

import tempfile

import numpy as np

# Entries that a queue keeps in memory before it spills.
QUEUE_ENTRIES = 4_000_000


class BucketQueue:
    """Buckets of (position, common prefix) entries, in memory or in a temporary file."""

    def __init__(self, limit: int = QUEUE_ENTRIES):
        self.limit, self.held, self.file = limit, 0, None
        self.memory: dict[int, list[np.ndarray]] = {}
        self.spilled: dict[int, list[tuple[int, int]]] = {}

    def push(self, bucket: int, positions: np.ndarray, common: np.ndarray) -> None:
        self.memory.setdefault(bucket, []).append(np.stack((positions, common)).astype(np.int32))
        self.held += len(positions)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for bucket, parts in self.memory.items():
            entries = np.ascontiguousarray(np.concatenate(parts, axis=1).T)
            self.spilled.setdefault(bucket, []).append((self.file.tell(), len(entries)))
            self.file.write(entries.tobytes())
        self.memory, self.held = {}, 0

    def drain(self, bucket: int) -> tuple[np.ndarray, np.ndarray]:
        """All entries of a bucket in the order they were pushed; they leave the queue."""
        parts = []
        for at, count in self.spilled.pop(bucket, []):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(8 * count), dtype=np.int32).reshape(-1, 2).T)
        mine = self.memory.pop(bucket, [])
        self.held -= sum(x.shape[1] for x in mine)
        both = np.concatenate([*parts, *mine], axis=1) if parts or mine else np.zeros((2, 0), np.int32)
        return both[0].astype(np.int64), both[1].astype(np.int64)

    def close(self) -> None:
        if self.file:
            self.file.close()


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is larger than the end."""
    n = len(text)
    rise = np.zeros(n, dtype=np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rise[-1] = -1
    at = np.where(rise != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rise[at] > 0


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How many equal bytes stand from each position on."""
    n = len(text)
    end = np.where(np.append(text[1:] != text[:-1], True), np.arange(n), n)
    return np.minimum.accumulate(end[::-1])[::-1] + 1 - np.arange(n)


def _between(common: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Common prefix of each chosen entry with the chosen one before it; 0 for the first."""
    out = np.zeros(len(chosen), dtype=np.int64)
    if len(chosen) > 1:
        out[1:] = np.minimum.reduceat(common, chosen[:-1] + 1)
        last = common[chosen[-2] + 1 : chosen[-1] + 1]
        out[-1] = last.min()
    return out


def _push_before(queue: BucketQueue, text: np.ndarray, sources: np.ndarray, common: np.ndarray, ok: np.ndarray, depth: int) -> None:
    """Push the suffixes one before ``sources`` where ``ok``, in their order, to the buckets of their bytes."""
    at = np.flatnonzero(ok)
    if not len(at):
        return
    byte = text[sources[at] - 1]
    order = np.argsort(byte, kind="stable")
    bounds = np.flatnonzero(np.diff(byte[order], prepend=-1, append=-1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        chosen = at[order[a:b]]
        queue.push(int(byte[order[a]]), sources[chosen] - 1, np.minimum(_between(common, chosen) + 1, depth))


def induce(text: np.ndarray, small: np.ndarray, lms: np.ndarray, lms_common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and the common prefix of each with the one before, from the LMS suffixes in order."""
    runs = np.minimum(run_lengths(text), depth)
    chars = np.unique(text).tolist()
    by_char = np.searchsorted(text[lms], [*chars, chars[-1] + 1])
    large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    queue = BucketQueue()
    queue.push(int(text[-1]), np.array([len(text) - 1]), np.array([0]))  # the last suffix is preceded by nothing
    for c, a, b in zip(chars, by_char[:-1].tolist(), by_char[1:].tolist()):
        position, common = queue.drain(c)
        parts, shared, level = [position], [common], 1
        while len(position):  # suffixes of the same byte, one longer each time
            before = position > 0
            before[before] = (text[position[before] - 1] == c) & ~small[position[before] - 1]
            at = np.flatnonzero(before)
            if not len(at):
                break
            common = np.minimum(_between(shared[-1], at) + 1, depth)
            common[0] = min(level, depth)
            position = position[at] - 1
            parts.append(position)
            shared.append(common)
            level += 1
        position, common = np.concatenate(parts), np.concatenate(shared)
        large[c] = (position, common)
        first = lms_common[a:b].copy()
        if b > a:
            first[0] = min(runs[position[-1]], runs[lms[a]]) if len(position) else 0
        source, common = np.concatenate((position, lms[a:b])), np.concatenate((common, first))
        ok = source > 0
        ok[ok] = ~small[source[ok] - 1] & (text[source[ok] - 1] > c)
        _push_before(queue, text, source, common, ok, depth)
    queue.close()

    # The small suffixes from the right; a common prefix here is with the larger neighbour.
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    queue = BucketQueue()
    for c in reversed(chars):
        position, common = queue.drain(c)
        parts, shared, level = [position], [common], 1
        while len(position):
            before = position > 0
            before[before] = (text[position[before] - 1] == c) & small[position[before] - 1]
            at = np.flatnonzero(before)
            if not len(at):
                break
            common = np.minimum(_between(shared[-1], at) + 1, depth)
            common[0] = min(level, depth)
            position = position[at] - 1
            parts.append(position)
            shared.append(common)
            level += 1
        position, common = np.concatenate(parts), np.concatenate(shared)
        high, high_common = large[c]
        # the large suffixes follow, from the right: prefix with the larger neighbour moves one place
        turned = np.append(high_common[1:], 0)[: len(high)][::-1]
        if len(position) and len(high):
            turned[0] = min(runs[position[-1]], runs[high[-1]])
        source, with_larger = np.concatenate((position, high[::-1])), np.concatenate((common, turned))
        ok = source > 0
        ok[ok] = small[source[ok] - 1] & (text[source[ok] - 1] < c)
        _push_before(queue, text, source, with_larger, ok, depth)
        with_smaller = np.append(with_larger[1:], 0)
        out[c] = (source[::-1], with_smaller[::-1])
    queue.close()
    return np.concatenate([out[c][0] for c in chars]), np.concatenate([out[c][1] for c in chars])


def common_prefixes(text: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of neighbours in ``positions``, up to ``depth``; 0 for the first."""
    out = np.zeros(len(positions), dtype=np.int64)
    # the end differs from every element, so two suffixes differ there at the latest
    padded = np.concatenate((text.astype(np.int16), np.full(depth, -1, dtype=np.int16)))
    heads = np.lib.stride_tricks.sliding_window_view(padded, depth)
    for a in range(1, len(positions), 20_000):
        two = positions[a : a + 20_000]
        same = heads[positions[a - 1 : a - 1 + len(two)]] == heads[two]
        first = same.argmin(axis=1)
        out[a : a + len(two)] = np.where(same[np.arange(len(two)), first], depth, first)
    return out


def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rank of each element from a sorted order and where a larger value begins in it."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (non-negative small integers) in order of their first ``depth`` elements, and common prefixes."""
    text = text.astype(np.int64)
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    small = suffix_types(text)
    lms = np.flatnonzero(small & np.append(False, ~small[:-1]))
    if len(lms) > 1:
        # order of the LMS substrings: induce from LMS suffixes in order of their first byte only
        start = lms[np.argsort(text[lms], kind="stable")]
        rough, _ = induce(text, small, start, np.zeros(len(start), np.int64), depth)
        is_lms = np.zeros(n, dtype=bool)
        is_lms[lms] = True
        sorted_lms = rough[is_lms[rough]]
        number = np.full(n, -1, dtype=np.int64)
        number[lms] = np.arange(len(lms))
        ends = np.append(lms[1:], n - 1)  # a substring ends with the first byte of the next
        length = ends - lms + 1
        length[-1] = n - lms[-1] + 1  # the last one has no equal
        of = number[sorted_lms]
        one, two = of[:-1], of[1:]
        differ = length[one] != length[two]
        same = np.flatnonzero(~differ)
        differ[same] = ~_equal_ranges(text, lms[one[same]], lms[two[same]], length[one[same]])
        name = _ranks(of, np.concatenate(([0], differ)).astype(np.int64))
        covered = 2
        while covered < depth + 2 and name.max() + 1 < len(name):
            ahead = covered // 2
            follow = np.concatenate((name[ahead:] + 1, np.zeros(min(ahead, len(name)), np.int64)))[: len(name)]
            order = np.lexsort((follow, name))
            new = np.concatenate(([0], (np.diff(name[order]) != 0) | (np.diff(follow[order]) != 0))).astype(np.int64)
            name, covered = _ranks(order, new), covered * 2
        lms = lms[np.argsort(name, kind="stable")]
    return induce(text, small, lms, common_prefixes(text, lms, depth), depth)


def _equal_ranges(text: np.ndarray, one: np.ndarray, two: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of equal length at ``one`` and ``two`` are equal."""
    if not len(one):
        return np.zeros(0, dtype=bool)
    first = np.concatenate(([0], np.cumsum(length)))
    steps = np.arange(first[-1]) - np.repeat(first[:-1], length)
    n = len(text)
    a, b = np.repeat(one, length) + steps, np.repeat(two, length) + steps
    same = (a < n) & (b < n)
    same[same] = text[a[same]] == text[b[same]]
    return np.logical_and.reduceat(same, first[:-1])
