"""Words and word shingles of whole Arrow batches as 64-bit hashes, in numpy.

A word's hash is a polynomial in its bytes, taken from one running sum over the chunk, so no Python
string is made per word. Hashes depend on the word's bytes alone, never on the place or the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_HORNER = _U(0xD1342543DE82EF95)

#: A-Z to a-z on bytes; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that ASCII white space bounds: all but 20 and 09-0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of alphanumeric words (after LOWER): digits, a-z and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    """mix() of one Python integer."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], _U))[0])


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@dataclass
class Chunk:
    """Words of the rows first..last-1 of a batch. row: of each word, relative to `first`; start, end: bytes in the batch."""

    first: int
    last: int
    row: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def bounds(self) -> np.ndarray:
        """Where each row's words begin; length rows + 1."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))


def row_chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `limit` bytes; a longer row is a run of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray) -> Iterator[Chunk]:
    """Words of every row, chunk by chunk, with A-Z lower-cased. in_word: by byte, after lower-casing."""
    for i, j in row_chunks(bounds):
        low = int(bounds[i])
        raw = LOWER[data[low : int(bounds[j])]]
        n = len(raw)
        cuts = bounds[i : j + 1] - low
        if not n:
            none = np.zeros(0, np.int64)
            yield Chunk(i, j, none, np.zeros(0, _U), none, none)
            continue
        inside = in_word[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = cuts[:-1][cuts[:-1] < n]
        begins[at] = inside[at]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        at = cuts[1:][cuts[1:] > 0] - 1
        ends[at] = inside[at]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        power, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, _U)
        terms = raw.astype(_U)
        terms += _U(1)
        terms *= power[:n]
        np.cumsum(terms, out=total[1:])
        value = (total[end] - total[start]) * inverse[start]
        value = mix(value + mix((end - start).astype(_U)))
        row = np.searchsorted(cuts, start, side="right") - 1
        yield Chunk(i, j, row, value, start + low, end + low)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words: element i covers words i..i+k-1. Empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = hashes[:n].copy()
    for d in range(1, k):
        total *= _HORNER
        total += hashes[d : d + n]
    return mix(total + _U(mix_int(k)))


def chunk_shingles(chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles inside rows: hash and row of each, in order of place. Rows of fewer than k words have none."""
    value = shingles(chunk.hash, k)
    if not len(value):
        return value, np.zeros(0, np.int64)
    row = chunk.row[: len(value)]
    whole = row == chunk.row[k - 1 :]
    return value[whole], row[whole]
