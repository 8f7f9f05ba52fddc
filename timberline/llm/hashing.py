"""Hash tables and word hashes over whole numpy arrays."""

from __future__ import annotations

import numpy as np

#: Odd multiplier that spreads keys over a table.
SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Numbering:
    """Numbers 64-bit keys from 0 on in the order they come; open addressing, all keys of a call at once."""

    def __init__(self, bits: int = 14) -> None:
        self.bits, self.used = bits, 0
        self.keys, self.number = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        at = (keys * SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        odd = np.flatnonzero((self.keys[at] != keys) & (self.number[at] >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & mask
            odd = odd[(self.keys[at[odd]] != keys[odd]) & (self.number[at[odd]] >= 0)]
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        return self.number[self._slots(keys)]

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that are not known yet."""
        numbers = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.used += len(keys)
        if 2 * self.used > len(self.keys):
            old = np.flatnonzero(self.number >= 0)
            keys, numbers = np.concatenate([self.keys[old], keys]), np.concatenate([self.number[old], numbers])
            while 2 * self.used > (1 << self.bits):
                self.bits += 1
            self.keys, self.number = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        while len(left):
            at = self._slots(keys[left])
            self.number[at] = numbers[left]  # of several for one place the last one stays
            won = self.number[at] == numbers[left]
            self.keys[at[won]] = keys[left[won]]
            left = left[~won]


class Multilinear:
    """64-bit hashes of stretches of small numbers: the sum of a random word per value times one per place."""

    def __init__(self, values: int, seed: int = 11) -> None:
        self.random = np.random.default_rng(seed)
        self.value = self._draw(values)
        self.place = self._draw(64)

    def _draw(self, n: int) -> np.ndarray:
        return self.random.integers(1, 1 << 63, n, np.uint64) << np.uint64(1) | np.uint64(1)

    def hashes(self, data: np.ndarray, starts: np.ndarray, silent: np.ndarray | None = None) -> np.ndarray:
        """Hash of each stretch that begins at ``starts`` (ascending, the first at 0 or later); silent places count nothing."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        lengths = np.diff(np.append(starts, len(data)))
        place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
        while len(self.place) < int(lengths.max()):
            self.place = np.concatenate([self.place, self._draw(len(self.place))])
        mixed = self.value[data[starts[0] :]]
        mixed *= self.place[place]
        if silent is not None:
            mixed[silent[starts[0] :]] = 0
        return np.add.reduceat(mixed, starts - starts[0])
