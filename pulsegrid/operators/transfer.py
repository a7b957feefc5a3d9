"""What a stretch of requests does to a token bucket, for every level it can start with.

Levels are whole micro-tokens, so everything is exact.  A refill adds a constant and stops at
the capacity; a request takes one token if there is one and changes nothing if not.  A stretch
therefore maps start levels to end levels piece by piece, each piece moved by a constant or all
sent to one level.  Stretches one after the other compose, so a log is cut into chunks, each
chunk is mapped on its own, and only the maps are read in order.

Pieces stay few: starts that differ by whole tokens meet as soon as one of them is refused
more often, and a pause that fills the bucket leaves a single piece.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from fractions import Fraction

import numpy as np


@dataclass(frozen=True)
class Bucket:
    """Capacity, size of a token and refill a microsecond, in whole units."""

    capacity: int
    token: int
    refill: int

    @classmethod
    def of(cls, capacity: int, rate: float) -> Bucket:
        """``rate`` tokens a second; rates are taken as fractions with a denominator up to a million."""
        exact = Fraction(rate).limit_denominator(1_000_000)
        token = 1_000_000 * exact.denominator
        return cls(capacity * token, token, exact.numerator)

    @property
    def full_after(self) -> int:
        """Microseconds that fill an empty bucket."""
        return -(-self.capacity // self.refill)

    def gained(self, micros: int) -> int:
        return self.capacity if micros >= self.full_after else micros * self.refill

    def decide(self, level: int) -> tuple[bool, int, int]:
        """One request: allowed, seconds to wait, level after it."""
        if level >= self.token:
            return True, 0, level - self.token
        return False, (self.token - level) // (self.refill * 1_000_000) + 1, level

    def decide_all(self, level: int, since: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """``decide`` for requests at sorted times, from ``level`` at ``since``: allowed, seconds to wait, level at the last, after it.

        Refused requests change nothing, so those before the time that completes a token are answered together.
        """
        times, passed, runs, i = at.tolist(), [], [], 0
        while i < len(times):
            level, since = min(self.capacity, level + self.gained(times[i] - since)), times[i]
            if level >= self.token:
                level -= self.token
                passed.append(i)
                i += 1
                continue
            end = bisect_left(times, since - (level - self.token) // self.refill, i + 1)
            runs.append((end - i, self.token - level, since))
            level, since = level + (times[end - 1] - since) * self.refill, times[end - 1]
            i = end
        allowed, wait = np.zeros(len(times), bool), np.zeros(len(times), np.int32)
        allowed[passed] = True
        if runs:
            count, lack, start = np.array(runs, np.int64).T
            lack = np.repeat(lack, count) - (at[~allowed] - np.repeat(start, count)) * self.refill
            wait[~allowed] = lack // (self.refill * 1_000_000) + 1
        return allowed, wait, level


class Map:
    """Start levels ``0 .. capacity`` to end levels: pieces from ``start`` on, moved (``moves``) or constant, with the level of their first start."""

    def __init__(self, bucket: Bucket, start: np.ndarray, level: np.ndarray, moves: np.ndarray):
        self.bucket, self.start, self.level, self.moves = bucket, start, level, moves

    @classmethod
    def identity(cls, bucket: Bucket) -> Map:
        return cls(bucket, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool))

    @property
    def constant(self) -> bool:
        return len(self.start) == 1 and not self.moves[0]

    def __call__(self, level: int) -> int:
        k = int(np.searchsorted(self.start, level, side="right")) - 1
        return int(self.level[k]) + (level - int(self.start[k]) if self.moves[k] else 0)

    def _ends(self) -> np.ndarray:
        """Level of the last start of each piece."""
        last = np.append(self.start[1:], self.bucket.capacity + 1) - 1
        return self.level + np.where(self.moves, last - self.start, 0)

    def _cut(self, at: int) -> Map:
        """Moving pieces that reach ``at`` from below, in two."""
        split = self.moves & (self.level < at) & (self._ends() >= at)
        if not split.any():
            return self
        k = np.flatnonzero(split)
        start = np.insert(self.start, k + 1, self.start[k] + (at - self.level[k]))
        return Map(self.bucket, start, np.insert(self.level, k + 1, at), np.insert(self.moves, k + 1, True))

    def _joined(self) -> Map:
        """Neighbours that one piece can say."""
        step = np.where(self.moves[:-1], np.diff(self.start), 0)
        new = np.append(True, (self.moves[1:] != self.moves[:-1]) | (self.level[1:] != self.level[:-1] + step))
        if new.all():
            return self
        return Map(self.bucket, self.start[new], self.level[new], self.moves[new])

    def refilled(self, gain: int) -> Map:
        if gain <= 0:
            return self
        raised = Map(self.bucket, self.start, self.level + gain, self.moves)._cut(self.bucket.capacity)
        full = raised.level >= self.bucket.capacity
        if not full.any():
            return raised
        level = np.where(full, self.bucket.capacity, raised.level)
        return Map(self.bucket, raised.start, level, raised.moves & ~full)._joined()

    def requested(self) -> Map:
        cut = self._cut(self.bucket.token)
        level = np.where(cut.level >= self.bucket.token, cut.level - self.bucket.token, cut.level)
        return Map(self.bucket, cut.start, level, cut.moves)._joined()

    def then(self, later: Map) -> Map:
        """This map, then ``later``."""
        cut = self
        for at in later.start[1:].tolist():
            cut = cut._cut(at)
        k = np.searchsorted(later.start, cut.level, side="right") - 1
        level = later.level[k] + np.where(later.moves[k], cut.level - later.start[k], 0)
        return Map(self.bucket, cut.start, level, cut.moves & later.moves[k])._joined()


def chunk_map(bucket: Bucket, times: np.ndarray) -> Map:
    """From the level at the first request, before it, to that after the last; ``times`` are sorted microseconds."""
    if len(times) == 1:
        return Map(bucket, np.array([0, bucket.token], np.int64), np.zeros(2, np.int64), np.ones(2, bool))
    found, before, alone = Map.identity(bucket), None, None
    for at in times.tolist():
        gain = 0 if before is None else bucket.gained(at - before)
        before = at
        if alone is None and gain >= bucket.capacity:
            alone = bucket.capacity
        elif alone is not None:
            alone = min(bucket.capacity, alone + gain)
        if alone is not None:  # every start has come to one level
            alone -= bucket.token if alone >= bucket.token else 0
            continue
        found = found.refilled(gain).requested()
        if found.constant:
            alone = int(found.level[0])
    if alone is None:
        return found
    return Map(bucket, np.zeros(1, np.int64), np.array([alone], np.int64), np.zeros(1, bool))
