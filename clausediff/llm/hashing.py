"""Vectorised hashes of words and word shingles over Arrow string columns.

Words are maximal runs of bytes other than space and U+0009 to U+000D, with
A-Z lower-cased. UTF-8 never uses those bytes inside a longer character, so
bytes and code points give the same words.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_ODD = np.random.default_rng(20240607).integers(0, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_ODD[63]) & ~7 | 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(7).integers(1, 2**63, size=256, dtype=np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0
#: Bytes that are hashed at once, unless one text is longer.
CHUNK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        made = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            power = np.full(size, base, dtype=np.uint64)
            power[0] = 1
            made.append(np.multiply.accumulate(power))
        _powers = (made[0], made[1])
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts ``data[offsets[i]:offsets[i+1]]``; where each text's words begin."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    stop = np.flatnonzero(~space & (after | edge[1:])) + 1
    power, inverse = _tables(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * power[: len(data)], out=total[1:])
    hashes = (total[stop] - total[start]) * inverse[start]
    return mix(hashes + (stop - start).astype(np.uint64) * _ODD[62]), np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` successive word hashes (of whatever text they are)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = words[:n] * _ODD[0]
    for i in range(1, k):
        total = total + words[i : i + n] * _ODD[i]
    return mix(total)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task``, which gives its worker's free memory back at its end: workers live on, and what one task has freed stays theirs else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL(None).malloc_trim(0)

    return run


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, words, bounds)`` for runs of rows of about CHUNK bytes."""
    data, offsets = texts(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        words, bounds = word_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        yield first, last, words, bounds
        first = last


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word shingles.

    A text with fewer words, but some, has its whole sequence as the only
    shingle; null, empty and blank texts have none.
    """
    for first, last, words, bounds in chunks(column):
        grams = shingle_hashes(words, k)
        for i in range(last - first):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                salted = words[a:b] * _ODD[: b - a] + np.uint64(int(_ODD[61]) * int(b - a) % 2**64)
                yield mix(np.sum(salted, keepdims=True))
            else:
                yield np.empty(0, np.uint64)
