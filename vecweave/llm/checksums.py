"""CRC-32 of texts that are put together from pieces, from the checksums of the pieces.

The checksum of two pieces is that of the first, moved over as many zero bytes as the second has, combined with that of
the second. Moving over is linear, so tables of it by byte serve whole arrays at a time.
"""

from __future__ import annotations

import functools

import numpy as np

# The reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_SHORT = 64


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by its values for each of the four bytes."""
    out = table[0][crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ table[byte][(crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


def _table_of(step) -> np.ndarray:
    """The table of a linear map: four rows of 256 values."""
    values = np.arange(256, dtype=np.uint32)
    return np.stack([step(values << np.uint32(8 * byte)) for byte in range(4)])


@functools.cache
def _over_one() -> np.ndarray:
    def step(crc: np.ndarray) -> np.ndarray:
        for _ in range(8):
            crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(_POLYNOMIAL), np.uint32(0))
        return crc

    return _table_of(step)


@functools.cache
def _over_short() -> np.ndarray:
    """Tables of moving over 0 to 63 bytes."""
    tables = [_table_of(lambda crc: crc)]
    for _ in range(_SHORT - 1):
        tables.append(_table_of(lambda crc: _apply(_over_one(), _apply(tables[-1], crc))))
    return np.stack(tables)


@functools.cache
def _over_power(power: int) -> np.ndarray:
    """Table of moving over 64 x 2^power bytes."""
    if power == 0:
        return _table_of(lambda crc: _apply(_over_one(), _apply(_over_short()[_SHORT - 1], crc)))
    half = _over_power(power - 1)
    return _table_of(lambda crc: _apply(half, _apply(half, crc)))


def moved_over(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums moved over so many bytes each."""
    tables, short = _over_short(), lengths % _SHORT
    out = tables[short, 0, crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out ^= tables[short, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    left, power = lengths // _SHORT, 0
    while left.any():
        some = np.flatnonzero(left & 1)
        out[some] = _apply(_over_power(power), out[some])
        left, power = left >> 1, power + 1
    return out
