"""The binary Golay code: every 23-bit word is within 3 bits of exactly one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, INFO = 23, 12
#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Codewords within 4 bits of a word: one, or six if the nearest is 3 bits away.
MOST = 6


def _remainder(word: int) -> int:
    for at in range(LENGTH - 1, 10, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each upper half of a word, and the errors of weight 4 or less by remainder (-1: none)."""
    upper = np.array([_remainder(info << 11) for info in range(1 << INFO)], dtype=np.int64)
    single = [_remainder(1 << at) for at in range(LENGTH)]
    errors = np.full((1 << 11, MOST), -1, dtype=np.int64)
    found = [0] * (1 << 11)
    for weight in range(5):
        for places in combinations(range(LENGTH), weight):
            rest = error = 0
            for at in places:
                rest ^= single[at]
                error |= 1 << at
            errors[rest, found[rest]] = error
            found[rest] += 1
    return upper, errors


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords within 4 bits, -1 where fewer than six.

    Two words that differ in at most 2 bits share an index: the codeword nearest to a word between
    them is within 3 bits of it, so within 4 of both.
    """
    upper, errors = _tables()
    words = words.astype(np.int64)
    patterns = errors[upper[words >> 11] ^ (words & 0x7FF)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)
