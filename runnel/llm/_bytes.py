"""Vectorised work on whole Arrow string columns as UTF-8 bytes: words, hashes, windows.

Nothing here loops over characters or words in Python; a block of documents is one byte array with offsets.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document forms a block of its own. Work on a block takes some 100 times its bytes.
BLOCK = 1 << 19
#: Documents handled at once.
ROWS = 4096

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=U) * U(_P))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is True for bytes in the closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return out


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `limit` bytes of text at most, each with its bytes and n + 1 offsets. Null counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        if col.null_count:
            col = pc.fill_null(col, "")
        data, offsets = text_buffer(col)
        n, at = len(col), 0
        while at < n:
            to = min(n, at + ROWS, max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, col, data
        give_back()


_KEPT: list = []


def kept_by_tasks(cached):
    """Declares a cache that the tasks of its module keep in a Python worker for the next ones; other modules' tasks drop it."""
    _KEPT.append(cached)
    return cached


def drop_others(module: str) -> None:
    """Empties what tasks of other modules have left in this worker."""
    left = [c for c in _KEPT if c.__module__ != module and c.cache_info().currsize]
    for cached in left:
        cached.cache_clear()
    if left:
        gc.collect()
        give_back()


def tidy(run):
    """A mapInArrow function that gives its memory back at the end of a partition, when its own state is gone."""

    @functools.wraps(run)
    def tidied(batches):
        drop_others(run.__module__)
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on through many tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        lib = ctypes.CDLL(None)
        return lib if hasattr(lib, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array without nulls, without a copy."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if offs is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    lo = np.cumprod(np.full(4096, _P, U)) * U(_P_INV)
    step = U(pow(_P, 4096, 1 << 64))
    hi = np.cumprod(np.full(n // 4096 + 1, step, U)) * U(pow(int(step), -1, 1 << 64))
    return (hi[:, None] * lo[None, :]).ravel()


@lru_cache(1)
def _inverse_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.cumprod(np.full(4096, _P_INV, U)) * U(_P)
    step = pow(_P_INV, 4096, 1 << 64)
    return lo, np.cumprod(np.full(n // 4096 + 1, step, U)) * U(pow(step, -1, 1 << 64))


def _room(n: int) -> int:
    return max(BLOCK + 4096, 1 << int(n).bit_length())


class Prefix:
    """Prefix sums from which the hash of any byte range comes in constant time."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE_HASH):
        room = _room(len(data))
        self.sums = np.empty(len(data) + 1, U)
        self.sums[0] = 0
        np.cumsum(table[data] * _powers(room)[: len(data)], out=self.sums[1:])
        self.lo, self.hi = _inverse_tables(room)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]."""
        at = starts.astype(np.int64)
        inv = self.lo[at & 4095] * self.hi[at >> 12]
        return mix((self.sums[ends] - self.sums[starts]) * inv + (ends - starts).astype(U) * _M1)


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of the class inside each document: starts, ends, and each document's first word (n + 1 entries)."""
    n = len(data)
    m = np.zeros(n + 2, dtype=np.int8)
    m[1:-1] = in_word[data]
    edge = m[1:] - m[:-1]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < n)])
    joined = inner[(m[inner] == 1) & (m[inner + 1] == 1)]
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(joined):
        starts, ends = np.sort(np.concatenate([starts, joined])), np.sort(np.concatenate([ends, joined]))
    return starts, ends, np.searchsorted(starts, offsets, "left")


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` consecutive words, and each document's first shingle. A document of fewer words, but not none, has one of all its words."""
    n_words = np.diff(first)
    count = np.where(n_words == 0, 0, np.maximum(n_words - width + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(bounds[-1], U)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - first[:-1], count)
    size = np.repeat(np.minimum(n_words, width), count)
    for k in range(width):
        live = size > k
        if live.all():
            out = mix(out * U(_P) + hashes[at + k])
        else:
            out[live] = mix(out[live] * U(_P) + hashes[at[live] + k])
    return mix(out + size.astype(U)), bounds
