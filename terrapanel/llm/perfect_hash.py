"""A minimal perfect hash of 128-bit digests in numpy: each of n distinct digests gets a slot of its own from 0 to n - 1.

Built in levels. A level has as many cells as keys are left; keys alone in
their cell stay, the others go on to the next level with another seed. A slot
is the number of taken cells before the key's own, over all levels. About three
fifths of the keys leave at each level, so building takes time in proportion
to n. A digest that was never put in is told apart by comparing it with the
one that the slot holds.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """64 bits of both halves of the digests, another function for each level."""
    with np.errstate(over="ignore"):
        x = keys[:, 0] ^ (keys[:, 1] * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(level * 0xD1B54A32D192ED03 % 2**64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Slots of the distinct rows of an (n, 2) array of uint64."""

    def __init__(self, keys: np.ndarray):
        left, self._levels, before = np.ascontiguousarray(keys, np.uint64), [], 0
        for level in range(_LEVELS):
            if not len(left):
                break
            size = len(left)
            cell = (_mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(cell, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + before
            self._levels.append((size, alone, rank))
            before = int(rank[-1]) + 1
            left = left[~alone[cell]]
        if len(left):
            raise ValueError("digests are not distinct")
        self.n = before
        self.digests = np.empty((before, 2), np.uint64)
        self.digests[self._place(keys)] = keys

    def _place(self, keys: np.ndarray) -> np.ndarray:
        slots, rows = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, rank) in enumerate(self._levels):
            cell = (_mix(keys[rows], level) % np.uint64(size)).astype(np.int64)
            here = alone[cell]
            slots[rows[here]] = rank[cell[here]]
            rows = rows[~here]
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not in the table."""
        keys = np.ascontiguousarray(keys, np.uint64)
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        slots = self._place(keys)
        return np.where((slots >= 0) & (self.digests[slots] == keys).all(axis=1), slots, -1)
