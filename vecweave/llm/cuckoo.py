"""Cuckoo filters: sets of 64-bit keys in about two bytes a key that also forget keys.

A key is kept as a 16-bit fingerprint in one of two buckets of four places; either bucket follows from the other and
the fingerprint. A filter answers "surely not here" or "perhaps here". Adding, finding and removing work on arrays of
keys; only keys that find both buckets full are moved one by one.
"""

from __future__ import annotations

import numpy as np

PLACES = 4
MAX_MOVES = 500
# Places are made for so many keys per key that is asked for.
ROOM = 1.25
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(keys: np.ndarray) -> np.ndarray:
    x = keys.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class CuckooFilter:
    def __init__(self, capacity: int, table: np.ndarray | None = None):
        """Room for ``capacity`` keys, or the ``table`` of a filter that was kept."""
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, capacity * ROOM / PLACES)))))
        self.table = np.zeros((buckets, PLACES), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        """A filter of different keys; it is made anew with twice the room in the rare case that keys don't fit."""
        capacity = max(1, len(keys))
        while True:
            made = cls(capacity)
            if made.add(keys):
                return made
            capacity *= 2

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(0, np.frombuffer(data, "<u2").reshape(-1, PLACES).astype(np.uint16))

    def to_bytes(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _where(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprints (never zero, which is an empty place) and both buckets."""
        mixed = _mixed(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mixed & self.mask
        return prints, first.astype(np.int64), self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return ((bucket.astype(np.uint64) ^ _mixed(prints)) & self.mask).astype(np.int64)

    def __contains__(self, key: int) -> bool:
        return bool(self.find(np.array([key]))[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._where(np.asarray(keys))
        at = prints[:, None]
        return (self.table[first] == at).any(axis=1) | (self.table[second] == at).any(axis=1)

    def _put(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put one key in each bucket that has a free place; True where a key was put."""
        put = np.zeros(len(prints), bool)
        left = np.arange(len(prints))
        while len(left):
            _, one = np.unique(buckets[left], return_index=True)  # one key for a bucket at a time
            chosen = left[one]
            free = self.table[buckets[chosen]] == 0
            fits = free.any(axis=1)
            at = chosen[fits]
            self.table[buckets[at], free[fits].argmax(axis=1)] = prints[at]
            put[at] = True
            full = np.zeros(len(self.table), bool)
            full[buckets[chosen[~fits]]] = True
            left = left[~put[left] & ~full[buckets[left]]]
        return put

    def add(self, keys: np.ndarray) -> bool:
        """Add keys, each as often as it is given; False if there is no room for them."""
        prints, first, second = self._where(np.asarray(keys))
        left = np.flatnonzero(~self._put(prints, first))
        left = left[~self._put(prints[left], second[left])]
        turn = 0
        for print_, bucket in zip(prints[left].tolist(), first[left].tolist()):
            for _ in range(MAX_MOVES):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = print_
                    break
                turn = (turn + 1) % PLACES
                moved = int(self.table[bucket, turn])
                self.table[bucket, turn] = print_
                print_ = moved
                bucket = int(self._other(np.array([bucket]), np.array([print_], np.uint16))[0])
            else:
                return False
        return True

    def remove(self, keys: np.ndarray) -> None:
        """Remove keys that are in the filter, each once."""
        for print_, first, second in zip(*(x.tolist() for x in self._where(np.asarray(keys)))):
            for bucket in (first, second):
                at = np.flatnonzero(self.table[bucket] == print_)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
