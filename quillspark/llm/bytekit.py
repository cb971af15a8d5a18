"""Vectorised text primitives on Arrow buffers.

A text column arrives as one byte buffer with row offsets.  Everything here
works on slices of at most ``CHUNK`` bytes (a longer single text is a slice of
its own), so memory follows the slice and not the Arrow batch.

Hashes are polynomial prefix sums modulo 2**64: ``hash(s, e)`` of any span
costs O(1) once the prefix sums are there.  They only nominate candidates;
callers compare the words or bytes themselves before they decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, grown on demand."""
    have = _powers.get("up")
    if have is None or len(have) < size:
        size = max(size, CHUNK + 1024)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            column = np.full(size, base, dtype=np.uint64)
            column[0] = 1
            _powers[key] = np.multiply.accumulate(column)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over the values; length n + 1."""
    up, _ = _table(len(values) + 1)
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each span [start, end) of the values behind ``pre``."""
    _, down = _table(len(pre) + 1)
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def grams(pre: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of each run of ``width`` values (n - width + 1 of them)."""
    n = len(pre) - width
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    _, down = _table(len(pre) + 1)
    return mix((pre[width : width + n] - pre[:n]) * down[:n])


def arrow_text(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string or binary column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    else:
        column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and len(buffers[2]) else np.empty(0, np.uint8)
    return data, offsets


def slices(batch: pa.RecordBatch, name: str, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets from 0) of at most ``limit`` bytes, or one row."""
    data, offsets = arrow_text(batch, name)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def int_column(batch: pa.RecordBatch, name: str) -> list[int | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class Units:
    """Words of a slice of texts: spans in ``data``, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
        """is_word: 256 flags; fold: 256 bytes that replace the text's bytes first."""
        self.data = fold[data] if fold is not None else data
        n = len(data)
        flags = is_word[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, flags[:-1]
            after[-1], after[:-1] = False, flags[1:]
        self.starts = np.flatnonzero(flags & (~before | edge[:n]))
        self.ends = np.flatnonzero(flags & (~after | edge[1 : n + 1])) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span(prefix(self.data), self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def word_table(separators: bytes, rest: bool = True) -> np.ndarray:
    """Flags of the bytes that make words: all but the separators."""
    out = np.full(256, rest)
    out[np.frombuffer(separators, dtype=np.uint8)] = not rest
    return out


#: Bytes below 0x80 that are not digits or lower-case letters separate words.
ALNUM = word_table(bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)))
#: White space separates words.
SPACE = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: A-Z become a-z, nothing else changes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: For ALNUM on raw bytes: capitals count as letters.
ALNUM_RAW = ALNUM[LOWER]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by block prefix and suffix minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    rows = -(-len(values) // width)
    grid = np.full(rows * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    grid[: len(values)] = values
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash in each window of ``width``; the leftmost of equal ones."""
    if len(hashes) >= 1 << 28:
        raise ValueError("a slice holds 2**28 units at most")
    low = np.uint64((1 << 28) - 1)
    tagged = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(tagged, width) & low).astype(np.int64)


def ranges_to_mask(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` units any of the ranges covers."""
    delta = np.zeros(size + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def mask_to_runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    padded = np.zeros(len(mask) + 2, dtype=np.int8)
    padded[1:-1] = mask
    step = np.diff(padded)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)
