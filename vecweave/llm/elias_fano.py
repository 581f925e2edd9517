"""Elias-Fano code of an ascending sequence of whole numbers.

A number is split into ``low`` bits, kept as they are, and the rest, kept as a bit string with the i-th one at place
(rest of the i-th number) + i. That takes about 2 + log2(range / count) bits a number. The places of every
``SAMPLE``-th one are kept in 32 bits, so that one number is found by looking at a few words.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEADER = "<QqQQQ"  # count, least, low bits, bytes of low bits, bytes of the bit string


class EliasFano:
    def __init__(self, count: int, least: int, low: int, lows: np.ndarray, bits: np.ndarray, places: np.ndarray):
        self.count, self.least, self.low = count, least, low
        self._lows, self._bits, self._places = lows, bits, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Code ascending 64-bit numbers; equal neighbours are fine."""
        values = np.asarray(values, dtype=np.int64)
        count = len(values)
        if count == 0:
            empty = np.zeros(0, np.uint8)
            return cls(0, 0, 0, empty, empty, np.zeros(0, np.uint32))
        if (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must ascend")
        least = int(values[0])
        over = values.view(np.uint64) - np.uint64(least & (1 << 64) - 1)
        low = max(0, (int(over[-1]) // count).bit_length() - 1)
        ones = (over >> np.uint64(low)).astype(np.int64) + np.arange(count)
        if ones[-1] >= 1 << 32:
            raise ValueError("too many numbers for one sequence")
        bits = np.zeros(int(ones[-1]) + 1, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low, dtype=np.uint64)
        lows = ((over[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        packed = lambda x: np.packbits(x, bitorder="little")
        return cls(count, least, low, packed(lows), packed(bits), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack(_HEADER, self.count, self.least, self.low, len(self._lows), len(self._bits))
        return head + self._places.astype("<u4").tobytes() + self._lows.tobytes() + self._bits.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, start: int = 0) -> tuple[EliasFano, int]:
        """The sequence that begins at ``start``, and where it ends."""
        count, least, low, low_bytes, bit_bytes = struct.unpack_from(_HEADER, data, start)
        at = start + struct.calcsize(_HEADER)
        samples = -(-count // SAMPLE)
        places = np.frombuffer(data, "<u4", samples, at)
        lows = np.frombuffer(data, np.uint8, low_bytes, at := at + 4 * samples)
        bits = np.frombuffer(data, np.uint8, bit_bytes, at := at + low_bytes)
        return cls(count, least, low, lows, bits, places), at + bit_bytes

    def _join(self, ones: np.ndarray, lows: np.ndarray, first: int) -> np.ndarray:
        high = (ones - np.arange(first, first + len(ones))).astype(np.uint64)
        over = (high << np.uint64(self.low)) | lows
        return (over + np.uint64(self.least & (1 << 64) - 1)).view(np.int64)

    def _low_parts(self, start: int, stop: int) -> np.ndarray:
        if not self.low:
            return np.zeros(stop - start, np.uint64)
        begin, end = start * self.low, stop * self.low
        bits = np.unpackbits(self._lows[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :]
        bits = bits[: end - begin].reshape(-1, self.low).astype(np.uint64)
        return (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def __len__(self) -> int:
        return self.count

    def decode(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self._bits, bitorder="little"))
        return self._join(ones[: self.count], self._low_parts(0, self.count), 0)

    def run(self, start: int, stop: int) -> np.ndarray:
        """The numbers from ``start`` to before ``stop``: from the sample before the first one, only the words up to the
        sample after the last one are looked at."""
        if not 0 <= start <= stop <= self.count:
            raise IndexError((start, stop))
        if start == stop:
            return np.zeros(0, np.int64)
        sample, after = start // SAMPLE, (stop - 1) // SAMPLE + 1
        begin = int(self._places[sample])
        end = int(self._places[after]) if after < len(self._places) else 8 * len(self._bits)
        bits = np.unpackbits(self._bits[begin // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[start % SAMPLE :][: stop - start] + begin
        return self._join(ones, self._low_parts(start, stop), start)

    def __getitem__(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        return int(self.run(i, i + 1)[0])
