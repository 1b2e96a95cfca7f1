"""Elias-Fano code of a non-decreasing sequence, with a sampled select directory (numpy).

``n`` values below ``universe`` take about ``2 + log2(universe / n)`` bits each: the low bits of
every value are packed side by side, the high bits are a bit vector in which value ``i`` sets bit
``high(i) + i``. ``select`` of the i-th set bit gives a value back; the directory keeps the position
of every 256th set bit in 32 bits, so a sequence holds fewer than 2**31 values.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEADER = struct.Struct("<QQB")


def _low_bits(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def encode(values: np.ndarray) -> bytes:
    """The code of non-decreasing, non-negative values."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    universe = int(v[-1]) + 1 if n else 0
    if n and np.any(v[1:] < v[:-1]):
        raise ValueError("values must not decrease")
    width = _low_bits(n, universe)
    shifts = np.arange(width, dtype=np.uint64)
    low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little")
    return HEADER.pack(n, universe, width) + low.tobytes() + ones[::SAMPLE].astype("<u4").tobytes() + high.tobytes()


class EliasFano:
    """Random access to an encoded sequence."""

    def __init__(self, data: bytes):
        self.n, self.universe, self.width = HEADER.unpack_from(data)
        at = HEADER.size
        n_low = (self.n * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at + n_low)
        self.high = np.frombuffer(data, np.uint8, offset=at + n_low + 4 * n_samples)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i[:, None] * self.width + np.arange(self.width)
        found = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        return (found.astype(np.int64) << np.arange(self.width)).sum(axis=1)

    def select(self, i: int) -> int:
        """Value ``i``, reading the bits between two samples only."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k = i // SAMPLE
        start = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[start >> 3:(stop >> 3) + 1], bitorder="little"))
        ones = ones[ones >= (start & 7)]
        one = (start >> 3) * 8 + int(ones[i % SAMPLE])
        return ((one - i) << self.width) | int(self._low(np.array([i]))[0])

    def all(self) -> np.ndarray:
        """Every value."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((ones - np.arange(self.n)) << self.width) | self._low(np.arange(self.n))
