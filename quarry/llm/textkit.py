"""Vectorised text primitives on Arrow string buffers: words, word hashes, n-grams.

All functions work on the UTF-8 bytes of a whole batch at once. Separators are ASCII, so byte
positions and words agree with a code-point reading of the same rule.
"""

from __future__ import annotations

import ctypes
import functools
import inspect

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GRAM = U64(0xD1342543DE82EF95)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

#: Bytes that separate words: space and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate plain words once A-Z are lower-cased: all ASCII but 0-9 and a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Bytes of text that are looked at together: a pass over them holds some tens of times as much.
PIECE = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def give_back() -> None:
    """Return freed memory to the system: a worker that waits or serves the next stage would keep its peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another C library
        pass


def frugal(f):
    """f for groups of a worker, without the memory of its temporaries afterwards."""

    @functools.wraps(f)
    def run(*args):
        try:
            return f(*args)
        finally:
            give_back()

    run.__signature__ = inspect.signature(f)  # Spark counts the parameters
    return run


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> list[tuple[int, int]]:
    """Runs (first, last+1) of whole rows with about `most` bytes; one row may exceed it."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def word_bounds(body: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word, in order."""
    n = len(body)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[body]
    first, last = np.empty(n, bool), np.empty(n, bool)
    first[0] = last[-1] = True
    first[1:] = ~inside[:-1]
    last[:-1] = ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(inside & first)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, the same wherever the word stands."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(body) + 1)
    sums = np.zeros(len(body) + 1, U64)
    np.cumsum(_BYTE[body] * power[: len(body)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def words(column: pa.ChunkedArray | pa.Array, separator: np.ndarray = BLANK, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, hash of each word) over a whole column, in text order."""
    body, offsets = buffers(column)
    rows, hashes = [], []
    for a, b in pieces(offsets):
        part = body[offsets[a] : offsets[b]]
        part = LOWER[part] if lower else part
        s, e, r = word_bounds(part, offsets[a : b + 1] - offsets[a], separator)
        rows.append(r + a)
        hashes.append(word_hashes(part, s, e))
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros(0, np.int64), np.zeros(0, U64))


def hash_word(word: str) -> int:
    body = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(body, np.array([0]), np.array([len(body)]))[0])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n-1 positions are left out."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(hashes) - n + 1, U64)
    for k in range(n):
        out *= _GRAM
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out + U64(n))


def same_row(rows: np.ndarray, n: int) -> np.ndarray:
    """For each n-word position, whether all its words are of one row."""
    return rows[: len(rows) - n + 1] == rows[n - 1 :] if len(rows) >= n else np.zeros(0, bool)


def first_of_row(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Position of each row's first word, with the total at the end."""
    return np.searchsorted(rows, np.arange(n_rows + 1))


def planes(values: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes first: bytes that seldom differ then compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()
