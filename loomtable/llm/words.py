"""Words and shingles of whole texts as 64-bit fingerprints, in numpy over Arrow batches.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r (UTF-8 keeps those bytes for
themselves); A-Z may be folded.  A word's fingerprint is a polynomial over a random byte table, mixed;
a shingle's is a mixed weighted sum of its words' fingerprints.  A null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
CHUNK_BYTES = 1 << 21
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13
_BACK = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the usual chunk's are kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES * 2), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= CHUNK_BYTES * 2:
            _powers[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray, fold: bool) -> np.ndarray:
    """s[i]: sum of the first i bytes' terms; with range_hash, the fingerprint of any byte range."""
    s = np.zeros(len(data) + 1, np.uint64)
    v = (_FOLDED if fold else _BYTE)[data]
    v *= powers(_BASE, len(data))
    np.cumsum(v, out=s[1:])
    return s


def range_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((s[end] - s[start]) * powers(_BACK, len(s))[start] + (end - start).astype(np.uint64))


def batches_of_bytes(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, whole texts as bytes); a chunk has at most this many bytes or one text."""
    i, n = 0, len(column)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    while i < n:
        j, total = i + 1, sizes[i]
        while j < n and total + sizes[j] <= most:
            total += sizes[j]
            j += 1
        yield i, [x or b"" for x in column.slice(i, j - i).cast(pa.binary()).to_pylist()]
        i = j


class Words:
    """The words of a chunk of texts: fingerprints, byte ranges, and first[d]:first[d + 1] for text d."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        space = _SPACE[data]
        turns = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = turns[::2], turns[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.text_at = at + 1
        self.first = np.searchsorted(self.start, self.text_at)
        self.hash = range_hash(prefix_sums(data, fold), self.start, self.end)

    def shingles(self, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, first[]) of each text's runs of ``size`` words in order; a shorter text that has words is one run."""
        h, counts = self.hash, np.diff(self.first)
        runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
        first = np.zeros(len(runs) + 1, np.int64)
        np.cumsum(runs, out=first[1:])
        out = np.zeros(first[-1], np.uint64)
        if len(h) >= size:
            sums = np.zeros(len(h) - size + 1, np.uint64)
            for j in range(size):
                sums += h[j:len(h) - size + 1 + j] * _PLACE[j]
            long = counts >= size
            inside = np.zeros(len(h) + 1, np.int64)
            np.add.at(inside, self.first[:-1][long], 1)
            np.add.at(inside, self.first[1:][long] - size + 1, -1)
            keep = np.cumsum(inside)[:len(sums)] > 0
            slots = np.ones(first[-1], bool)
            slots[first[:-1][~long & (counts > 0)]] = False
            out[slots] = mixed(sums[keep])
        for d in np.flatnonzero((counts > 0) & (counts < size)):
            a, n = self.first[d], counts[d]
            out[first[d]] = mixed((h[a:a + n] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))[0]
        return out, first
