"""The binary Golay code of length 23, for fuzzy hashing.

Every 23-bit word lies within 3 bits of exactly one codeword. keys() gives a word's codeword index and, where the
word is 3 bits from it, the indices of the codewords at 4 bits, which its neighbours may decode to: two words at most
one bit apart share an index.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, CHECK_BITS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and of the high 11 bits; the error word of each remainder."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            errors[_remainder(word)] = word
    return low, high, errors


def decode(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (the 12 message bits) of the nearest codeword, and its distance."""
    low, high, errors = tables()
    error = errors[low[words & 0xFFF] ^ high[words >> 12]]
    return (words ^ error) >> CHECK_BITS, np.bitwise_count(error).astype(np.int64)


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in words, index), without repeats: one index, or six where the distance is 3."""
    first, distance = decode(words)
    far = np.flatnonzero(distance == 3)
    near = decode((words[far, None] ^ (1 << np.arange(LENGTH))).ravel())[0].reshape(len(far), LENGTH)
    near.sort(axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    fresh &= near != first[far, None]
    row, column = np.nonzero(fresh)
    return np.concatenate((np.arange(len(words)), far[row])), np.concatenate((first, near[row, column]))
