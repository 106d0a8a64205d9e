"""The binary Golay code (23, 12, 7): nearest-codeword decoding of 23-bit words in numpy."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the cyclic code
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each bit position, error pattern of each syndrome)."""
    single = np.array([_remainder(1 << b) for b in range(LENGTH)], np.int64)
    error = np.zeros(1 << CHECK, np.int64)
    for weight in (1, 2, 3):  # the code is perfect: each syndrome has one pattern of at most three errors
        for bits in combinations(range(LENGTH), weight):
            s = 0
            for b in bits:
                s ^= int(single[b])
            error[s] = sum(1 << b for b in bits)
    return single, error


def syndrome(words: np.ndarray) -> np.ndarray:
    single, _ = _tables()
    out = np.zeros_like(words)
    for b in range(LENGTH):
        out ^= np.where(words >> b & 1, single[b], 0)
    return out


def decode(words: np.ndarray, syndromes: np.ndarray | None = None) -> np.ndarray:
    """12-bit index of the codeword nearest to each word."""
    _, error = _tables()
    return (words ^ error[syndrome(words) if syndromes is None else syndromes]) >> CHECK


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own index, sorted indices of the word and of its 23 one-bit neighbours with repeats as -1).

    A word at distance up to 2 from its codeword has one such index, any other
    word has six. Two words that differ in one bit: the own index of either is
    among the indices of the other. Two that differ in two bits share an index,
    that of the word between them.
    """
    single, error = _tables()
    s = syndrome(words)
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    moved = words[:, None] ^ flips[None, :]
    found = np.sort((moved ^ error[s[:, None] ^ np.concatenate([[0], single])[None, :]]) >> CHECK, axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return decode(words, s), -np.sort(-found, axis=1)[:, :6]
