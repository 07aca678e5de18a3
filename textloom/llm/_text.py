"""Words and n-gram hashes of Arrow text columns, as flat numpy arrays.

Texts stay in Arrow's byte buffer: no Python string is made for a row or a word.
Hashes are polynomial in 64-bit arithmetic, then mixed; every function works on
slices of bounded size, so memory does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What parts words of letters and digits: every other ASCII byte.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0xA4CF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse; one table for each base, grown by doubling."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        tables = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(1 << max(16, int(n - 1).bit_length()), b, U64)
            p[0] = 1
            tables.append(np.multiply.accumulate(p, out=p))
        _POWERS[which] = tables[0], tables[1]
    up, down = _POWERS[which]
    return up[:n], down[:n]


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of values[start:end] for each span, the same wherever the span lies."""
    n = len(values)
    up, down = powers(n + 1, which)
    total = np.zeros(n + 1, U64)
    part = total[1:]
    part[:] = values
    part += U64(1)
    part *= up[:n]
    np.cumsum(part, out=part)
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


@dataclass
class Rows:
    """Some consecutive rows of a text column: bytes, and where each row begins and ends."""

    first: int
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Rows:
        return Rows(self.first, LOWER[self.data], self.bounds)

    def text(self, row: int) -> str:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes().decode("utf-8", "replace")


@dataclass
class Words:
    """Words of some rows: byte spans, the row of each, and where each row's words begin."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Rows]:
    """A text column in pieces of about ``limit`` bytes, whole rows each; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield Rows(at, raw[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the characters of scripts without spaces between words.

    Thai, Lao, Myanmar, Khmer, U+2E80 to U+A4CF (kana, Chinese characters and their marks),
    compatibility and halfwidth forms, and the supplementary Chinese characters.
    """
    at = np.flatnonzero(data[:-2] >= 0xE0) if len(data) > 2 else np.zeros(0, np.int64)
    code = data[at].astype(np.int64) << 12 | (data[at + 1] & 63).astype(np.int64) << 6 | (data[at + 2] & 63)
    code &= 0xFFFF
    wide = (data[at] < 0xF0) & np.logical_or.reduce([(code >= a) & (code <= b) for a, b in _UNSPACED])
    far = (data[at] == 0xF0) & (data[at + 1] >= 0xA0)
    return np.concatenate([at[wide], at[far]]), np.concatenate([at[wide] + 3, at[far] + 4])


def words(rows: Rows, which: int = 0, gap: np.ndarray = _SPACE, characters: bool = False) -> Words:
    """Words of each row, with hashes of their bytes: runs of bytes that are not in ``gap``.

    With ``characters`` each character of an unspaced script is a word by itself.
    """
    data, bounds = rows.data, rows.bounds
    n = len(data)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(gap[data], out=inside[1:-1])
    here = inside[1:-1]
    begins, ends = here & ~inside[:-2], here & ~inside[2:]
    cut = bounds[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    begins[cut] = here[cut]
    ends[cut - 1] = here[cut - 1]
    if characters:
        a, b = unspaced(data)
        begins[a], ends[b - 1] = True, True
        a, b = a[a > 0], b[b < n]
        ends[a - 1], begins[b] = here[a - 1], here[b]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, bounds)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    return Words(start, end, row, first, span_hash(data, start, end, which))


def grams(w: Words, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words within a row, and the index of its first word."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.row[:n] == w.row[size - 1 :])
    return span_hash(w.hash, at, at + size, which), at


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each length, joined."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    offset = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - offset, length)


def strings(data: bytes | np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow strings over one buffer of valid UTF-8."""
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data)).cast(pa.string())
