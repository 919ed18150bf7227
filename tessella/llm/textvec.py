"""Vectorised text primitives over Arrow string columns (numpy only, no Python string per word).

Every function works on one *chunk*: the UTF-8 bytes of some whole texts and their offsets. Words are the
maximal runs of bytes other than space and 0x09-0x0D, so they can be found on bytes without decoding.
Hashes are 64-bit: a polynomial over per-byte random values with an odd base (prefix sums modulo 2**64),
then a bijective finaliser.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: Bytes of text after which unused memory is given back, which takes time of its own.
TIDY_BYTES = 16 << 20
_since_tidy = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, in place on a fresh array."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def tidy() -> None:
    """Gives unused memory back to the system, where the C library can: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; a chunk has at least one whole row."""
    global _since_tidy
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    _since_tidy += int(offsets[n] - offsets[0])
    if _since_tidy >= TIDY_BYTES:
        _since_tidy = 0
        tidy()


@dataclass
class Hasher:
    """Hashes of any byte ranges of a chunk, from one prefix sum."""

    sums: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray) -> Hasher:
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        values = BYTE_VALUES[raw]
        values *= up[: len(raw)]
        np.cumsum(values, out=sums[1:])
        return cls(sums, down)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        return mix(h)


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text: index of its first word; one entry more than texts

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE) -> Words:
    """Maximal runs, within texts, of bytes that ``between`` (a flag for each byte value) doesn't mark."""
    inside = ~between[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge[:-1] | ~before))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of flags (one for each byte or word) in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words within texts, and the index of the first word of each."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += hashes[k : k + n]
    docs = np.repeat(np.arange(len(first) - 1), np.diff(first))
    same = np.flatnonzero(docs[:n] == docs[size - 1 :])
    return mix(h[same]), same
