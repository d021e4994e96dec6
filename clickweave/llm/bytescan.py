"""Vectorized helpers over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


class Chunk(NamedTuple):
    """Neighbouring texts: rows ``first`` and on of a batch, their bytes end to end, and where each starts (and the end)."""

    first: int
    data: np.ndarray
    bounds: np.ndarray


def chunks(column: pa.Array, most: int = 1 << 19) -> Iterator[Chunk]:
    """The texts of a binary column, null as empty, in stretches of about ``most`` bytes; a longer text is one by itself."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    n = len(column)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Chunk(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash's base and of its inverse, as many as were asked for so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = 1 << (n - 1).bit_length()
            cls.up = _powers(int(_BASE), size)
            cls.down = _powers(pow(int(_BASE), -1, 1 << 64), size)
        return cls.up, cls.down


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hash of any stretch of a sequence of bytes or of 64-bit values, from one pass over it."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = _Powers.get(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_SIGNS[values] if values.dtype == np.uint8 else values) * self.up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


class Words(NamedTuple):
    """Words of a chunk: byte spans, and for each text the number of its first word (and the end)."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def inside_word(data: np.ndarray) -> np.ndarray:
    """Which bytes are part of a word."""
    return _IS_WORD[data]


def words(chunk: Chunk) -> Words:
    """Longest stretches without space, tab, line feed, vertical tab, form feed and carriage return."""
    inside = inside_word(chunk.data)
    opens = np.zeros(len(inside) + 1, bool)
    opens[chunk.bounds] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (opens[:-1] | ~before))
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (opens[1:] | ~after)) + 1
    return Words(starts, ends, np.searchsorted(starts, chunk.bounds))


def word_hashes(chunk: Chunk, found: Words) -> np.ndarray:
    return Hashes(chunk.data).of(found.starts, found.ends)
