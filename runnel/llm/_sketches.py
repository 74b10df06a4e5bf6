"""Sums and unions of fixed-size arrays over all partitions; what reaches the driver has a fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import give_back, mix

PIECES = 64


def combined(df: DataFrame, size: int, add: Callable, union: bool = False) -> np.ndarray:
    """An int32 array of `size` entries: each partition starts from zeros and lets add(batch, array) change it; arrays are then summed (or joined bit by bit)."""

    def part(batches):
        own = np.zeros(size, np.int32)
        for batch in batches:
            add(batch, own)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array([_planes(x) for x in np.split(own, PIECES)], pa.binary())], names=["piece", "body"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for body in batch.column(1):
                x = _values(body.as_py())
                out = x.copy() if out is None else np.bitwise_or(out, x, out=out) if union else np.minimum(out.astype(np.int64) + x, (1 << 31) - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_planes(out)], pa.binary())], names=["piece", "body"])

    schema = "piece int, body binary"
    found = {r.piece: r.body for r in df.mapInArrow(part, schema).groupBy("piece").applyInArrow(merge, schema).collect()}
    blank = bytes(4 * size // PIECES)
    return np.concatenate([_values(found.get(i, blank)) for i in range(PIECES)])


def _planes(x: np.ndarray) -> bytes:
    """The numbers' low bytes first, then the next ones: mostly zeros, which shuffles compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T).tobytes()


def _values(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view(np.int32).ravel()


#: Bits of a membership filter at most: 32 MB, enough for 16 million ids. Beyond, more rows that are no members are shuffled.
FILTER_BITS = 28
PROBES = 4


def _bits(ids: np.ndarray, bits: int) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[None, :] + np.arange(PROBES, dtype=np.uint64)[:, None] * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


def members_apart(df: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows that may have an id of `ids` (one long column), and rows that surely have not.

    A Bloom filter of bounded size decides, so that only the first part has to be shuffled for an exact join. No member is in the second.
    """
    n = ids.count()
    bits = max(16, min(FILTER_BITS, int(16 * max(1, n)).bit_length()))

    def add(batch, own):
        at = _bits(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
        np.bitwise_or.at(own, at >> 5, (np.int64(1) << (at & 31)).astype(np.uint32).view(np.int32))

    table = combined(ids.where(F.col(ids.columns[0]).isNotNull()), max(PIECES, (1 << bits) >> 5), add, union=True)
    shared = df.sparkSession.sparkContext.broadcast(table)
    at = df.columns.index(id_col)

    def part(wanted: bool):
        def run(batches):
            table = shared.value
            for batch in batches:
                col = batch.column(at)
                probe = _bits(col.fill_null(0).to_numpy(zero_copy_only=False), bits)
                hit = (((table[probe >> 5] >> (probe & 31)) & 1) == 1).all(0) & col.is_valid().to_numpy(zero_copy_only=False)
                if (hit == wanted).any():
                    yield batch.filter(pa.array(hit == wanted))
                del batch, col
                give_back()

        return df.mapInArrow(run, df.schema)

    return part(True), part(False)


def only_members(df: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The first part of members_apart()."""
    return members_apart(df, id_col, ids)[0]
