"""CRC-32 of joined pieces from the pieces' own CRCs.

Appending n bytes to a message multiplies its CRC register by a matrix over GF(2) that depends on n
alone, so crc(a + b) = shift(crc(a), len(b)) ^ crc(b). A shift by n bytes is a product of the shifts
by the powers of two in n; each of those is kept as four tables of 256 words, one for a byte of the
register, so whole arrays are shifted by look-ups.
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: The reflected polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    """The product over GF(2) of a matrix, given by its columns, and a vector of bits."""
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


@cache
def _matrix(power: int) -> tuple[int, ...]:
    """The columns of the matrix that appends 2**power zero bytes."""
    if power == 0:
        bit = [POLYNOMIAL, *(1 << i for i in range(31))]  # one zero bit
        for _ in range(3):  # squared thrice: eight of them
            bit = [_times(bit, column) for column in bit]
        return tuple(bit)
    half = list(_matrix(power - 1))
    return tuple(_times(half, column) for column in half)


@cache
def _tables(power: int) -> np.ndarray:
    matrix = list(_matrix(power))
    return np.array([[_times(matrix, value << (8 * place)) for value in range(256)] for place in range(4)], np.uint32)


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC's contribution to that of a message with so many more bytes after it."""
    out, left, power = crcs.astype(np.uint32), lengths.astype(np.int64), 0
    while len(left) and left.max() >> power:
        at = np.flatnonzero(left >> power & 1)
        c, t = out[at], _tables(power)
        out[at] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
        power += 1
    return out


def joined(first: np.ndarray, second: np.ndarray, second_lengths: np.ndarray) -> np.ndarray:
    """CRCs of the messages a + b, from those of a and b and the lengths of b."""
    return shifted(first, second_lengths) ^ second.astype(np.uint32)
