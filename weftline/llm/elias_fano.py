"""Elias-Fano coding of a non-decreasing integer sequence, with sampled select.

A value splits into ``low_bits`` low bits, stored in a packed array, and a high part, stored in unary: value i
sets bit ``high_i + i`` of the upper bit array. select(i) finds the i-th set bit from the nearest sampled
position. About 2 + log2(universe / n) bits a value, against 64 for a plain table.
"""

from __future__ import annotations

import struct

import numpy as np

#: Every so many-th set bit's position is stored.
SAMPLE = 64
HEADER = struct.Struct("<QQBxxxxxxx")


def encode(values: np.ndarray) -> bytes:
    """values: non-decreasing, not negative. An empty sequence gives a header alone."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return HEADER.pack(0, 0, 0)
    universe = int(values[-1]) + 1
    low_bits = max(0, (universe // n).bit_length() - 1)
    high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(high[-1]) + 1, np.uint8)
    upper[high] = 1
    low = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    samples = high[::SAMPLE].astype("<u4")
    return HEADER.pack(n, len(upper), low_bits) + samples.tobytes() + np.packbits(low.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(upper, bitorder="little").tobytes()


class EliasFano:
    """Reads what encode() wrote."""

    def __init__(self, data: bytes):
        self.n, self.n_upper, self.low_bits = HEADER.unpack_from(data)
        at = HEADER.size
        n_samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        n_low = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.upper = np.frombuffer(data, np.uint8, -(-self.n_upper // 8), at + n_low)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        bit, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= (int(self.low[(bit + k) >> 3]) >> ((bit + k) & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Value i, from one sample and the upper bits after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = position >> 3
        bits = int(self.upper[byte]) >> (position & 7) << (position & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.upper[byte])
        for _ in range(left):
            bits &= bits - 1
        position = 8 * byte + (bits & -bits).bit_length() - 1
        return (position - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every value, for a scan of the whole file."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.upper, bitorder="little")) - np.arange(self.n)
        low = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits).astype(np.int64)
        return (high << self.low_bits) + (low << np.arange(self.low_bits)).sum(1)
