"""Word hashes of whole UTF-8 columns with numpy: no string object is made for any word.

A block of texts is one byte array. A random 64-bit value per byte times a power of an odd base gives prefix sums
modulo 2**64, so the hash of any byte range is a difference, brought back to a common power and finalised.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240611)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of words after lower-casing: letters, digits, and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: All bytes but ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to ``n``; long ones aren't kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    n = max(n, 1 << 16)
    with np.errstate(over="ignore"):
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x))
    if n <= 1 << 22:
        _powers[:] = made
    return made[0], made[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows, their byte starts, and for each row the index of its first word.

    ``data`` is lower-cased (A-Z) by the caller's choice of ``LOWER[data]``; ``offsets`` are relative to it; a word is
    a longest run of bytes in ``keep`` within a row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = keep[data]
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] |= inside[1:-1][offsets[:-1][full]]
    last[offsets[1:][full] - 1] |= inside[1:-1][offsets[1:][full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, rows not minded; ``len(hashes) - k + 1`` of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(k) * _GRAM[63], np.uint64)
        for j in range(k):
            out += hashes[j : j + n] * _GRAM[j]
    return mix(out)
