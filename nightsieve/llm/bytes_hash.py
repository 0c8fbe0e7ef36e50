"""Vectorised hashes of words, shingles and byte ranges over many texts at once.

A chunk of texts is one byte array with bounds.  Hashes are polynomials modulo 2**64 over random 64-bit byte
values, read from one running sum, and finished with a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, U(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


_POWERS = _Powers()


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a text or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` bytes; a longer text is a range of its own."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, j
        i = j


class RangeHash:
    """Hashes of byte ranges of one array, each in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.get(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_VALUES[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of `width` bytes, by its start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, U)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + U(width))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of each run of bytes outside space and 09-0D, A-Z lowered, in order."""
    if not len(data):
        return np.empty(0, U), np.empty(0, np.int64)
    low = _LOWER[data]
    gap = _GAP[low]
    inner = bounds[:-1][np.diff(bounds) > 0]
    first = ~gap
    first[1:] &= gap[:-1]
    first[inner] = ~gap[inner]
    last = ~gap
    last[:-1] &= gap[1:]
    tails = bounds[1:][np.diff(bounds) > 0] - 1
    last[tails] = ~gap[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return RangeHash(low)(start, end), np.searchsorted(bounds, start, "right") - 1


def shingles(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, as (values, bounds).

    A text with fewer than `width` words has its whole sequence as one shingle, one without words has none.
    """
    word, owner = words(data, bounds)
    n = len(bounds) - 1
    count = np.bincount(owner, minlength=n).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(count)))
    full = np.zeros(0, np.int64)
    if len(word) >= width:
        full = np.flatnonzero(owner[:len(word) - width + 1] == owner[width - 1:])
    value = np.zeros(len(full), U)
    for j in range(width):
        value = mix(value * U(BASE) + word[full + j])
    short = np.flatnonzero((count > 0) & (count < width))
    brief = mix(count[short].astype(U))
    for j in range(width - 1):
        has = count[short] > j
        brief[has] = mix(brief[has] * U(BASE) + word[at[short[has]] + j])
    who = np.concatenate((owner[full], short)) if len(short) else owner[full]
    value = np.concatenate((value, brief)) if len(short) else value
    if len(short):
        order = np.argsort(who, kind="stable")
        who, value = who[order], value[order]
    size = np.bincount(who, minlength=n).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(size)))
    for a, b in zip(edges[:-1][size > 1], edges[1:][size > 1]):
        value[a:b].sort()
    keep = np.ones(len(value), bool)
    if len(value) > 1:
        keep[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[keep], np.concatenate(([0], np.cumsum(np.bincount(who[keep], minlength=n)))).astype(np.int64)
