"""Numpy views of Arrow text columns: words, their 64-bit hashes and word shingles, for whole batches at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_GOLDEN, _MIX1, _MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLDEN
    x ^= x >> U64(30)
    x *= _MIX1
    x ^= x >> U64(27)
    x *= _MIX2
    x ^= x >> U64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system. Workers live on between tasks, and what they have freed but kept counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives memory back when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64(np.arange(256, dtype=U64))
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_VALUE[SPACE] = 0
_STEP = U64(0xD1342543DE82EF95)
_POWERS = np.ones(1, U64)
#: A value for each byte, capitals told apart.
VALUE = mix64(np.arange(1, 257, dtype=U64))
_BACK_STEP = U64(pow(int(_STEP), -1, 1 << 64))
_BACK = np.ones(1, U64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n + n // 4, _STEP)]))
    return _POWERS


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse: a run's hash doesn't depend on where it stands."""
    global _BACK
    forward = _powers(n)
    if len(_BACK) < n:
        _BACK = np.cumprod(np.concatenate([np.ones(1, U64), np.full(n + n // 4, _BACK_STEP)]))
    return forward, _BACK


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if at is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, off - off[0]


def pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole rows of about ``most`` bytes; a longer row stands alone."""
    body, off = utf8(column)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, "right")) - 1)
        yield row, end, body[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_spans(body: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one entry more than rows)."""
    inside = ~space[body]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = off[:-1] < off[1:]
    a, z = off[:-1][full], off[1:][full] - 1
    first[a], last[z] = inside[a], inside[z]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, U64)
    until = np.append(starts[1:], len(body))
    place = np.arange(starts[0], len(body)) - np.repeat(starts, until - starts)
    values = _VALUE[body[starts[0] :]] * _powers(int((until - starts).max()) + 1)[place]
    return mix64(np.add.reduceat(values, starts - starts[0]) + (ends - starts).astype(U64))


def combined(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word."""
    if len(words) < n:
        return np.zeros(0, U64)
    total = np.zeros(len(words) - n + 1, U64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _powers(65)[k * 2 + 1]
    return mix64(total + U64(n))


def shingle_sets(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its distinct hashed runs of ``n`` words, sorted; with fewer words, the one run of them all."""
    runs = combined(words, n)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= n:
            yield np.unique(runs[a : z - n + 1])
        elif z > a:
            yield combined(words[a:z], z - a)
        else:
            yield np.zeros(0, U64)
