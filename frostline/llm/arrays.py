"""Texts of an Arrow column as numpy arrays: chunks, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once.
CHUNK = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]

#: Bytes of words that end at white space, and of words that are letters only (with all of UTF-8 beyond ASCII).
SOLID = np.ones(256, dtype=bool)
SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text starts and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts, some at a time: first row, row after the last, bytes, offsets."""
    data, offsets = text_bytes(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def prefix_hash(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Running polynomial hash; with it any span's hash takes one subtraction."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _VALUES)[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end, the same wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, of: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of the bytes ``of``, and each text's first; texts end words."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = of[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: bool = True, of: np.ndarray = SOLID,
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased if fold), and each text's first word."""
    start, end, first = word_spans(data, offsets, of)
    return span_hash(prefix_hash(data, fold), start, end), first


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _BASE + words[i : i + n]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    With fewer words than ``size`` the whole sequence is one shingle; without
    words the set is empty.
    """
    words, first = word_hashes(data, offsets)
    runs = shingle_hashes(words, size)
    sets = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            sets.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            sets.append(shingle_hashes(words[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            sets.append(words[:0])
    return sets


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values, which start at ``first`` and end where the next text's start."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
