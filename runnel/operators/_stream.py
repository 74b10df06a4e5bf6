"""Rows of each group in order, streamed through a Python state: for folds that no window frame expresses.

One task takes whole groups, sorted by Spark (which spills); memory is one state, not one group. A flow without keys is one
sequence and so one task. Values reach Python from Arrow as they are: a null key is a group like any other, long keys stay
whole, null values are None.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def heads(keys: list[pa.Array]) -> list[int]:
    """Where a row's key is unlike the one before; the first row is not told of. Nulls are alike, and so are NaNs."""
    if not keys or len(keys[0]) < 2:
        return []
    new = None
    for col in keys:
        a, b = col.slice(0, len(col) - 1), col.slice(1)
        if pa.types.is_nested(col.type):
            values = col.to_pylist()
            unlike = pa.array([x != y for x, y in zip(values, values[1:])])
        else:
            unlike = pc.if_else(pc.and_(a.is_null(), b.is_null()), False, pc.fill_null(pc.not_equal(a, b), True))
            if pa.types.is_floating(col.type):
                unlike = pc.and_(unlike, pc.invert(pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)))
        new = unlike if new is None else pc.or_(new, unlike)
    return [i + 1 for i, x in enumerate(new.to_pylist()) if x]


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of one group each, in order, and whether a piece begins its group; the keys are the first columns."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i) for i in range(n_keys)]
        begins = last is None or bool(heads([pa.concat_arrays([a, k.slice(0, 1)]) for a, k in zip(last, keys, strict=True)]))
        cut = [0, *heads(keys), batch.num_rows]
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            yield i > 0 or begins, batch.slice(a, b - a)
        last = [k.slice(batch.num_rows - 1) for k in keys]


def in_groups(flow, df: DataFrame) -> DataFrame:
    """The rows, whole groups in a task, sorted."""
    dealt = df.repartition(*[F.col(k) for k in flow.by]) if flow.by else df.coalesce(1)
    return dealt.sortWithinPartitions(*flow.by, *flow.asc())


def by_group(flow, start: Callable, step: Callable, schema: str, value: str, finish: Callable | None = None) -> DataFrame:
    """schema names the keys, then out columns. step(state, value) gives (state, rows to emit); finish(state) the last rows. Rows are tuples."""
    n = len(flow.by)
    df = flow.df.select(*flow.by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(flow.order)], F.col(value).alias("__value"))
    dealt = df.repartition(*[F.col(k) for k in flow.by]) if flow.by else df.coalesce(1)
    dealt = dealt.sortWithinPartitions(*flow.by, *[F.asc_nulls_first(f"__o{i}") for i in range(len(flow.order))]).select(*flow.by, "__value")
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def gathered(pieces: Iterator[tuple[tuple, list]]) -> Iterator[pa.RecordBatch]:
        """Pieces of rows as batches of a fair size."""
        held: list[tuple] = []
        for key, rows in pieces:
            held += [(*key, *r) for r in rows]
            if len(held) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types, strict=True)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kind.types, strict=True)], schema=kind)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list]]:
        key, state, seen = (), None, False
        for begins, piece in groups(batches, n):
            if begins:
                if seen and finish:
                    yield key, list(finish(state))
                key, state, seen = tuple(piece.column(i)[0].as_py() for i in range(n)), start(), True
            rows: list[tuple] = []
            for v in piece.column(n).to_pylist():
                state, out = step(state, v)
                rows += out
            yield key, rows
        if finish and (seen or not n):
            yield key, list(finish(state if seen else start()))

    return dealt.mapInArrow(lambda batches: gathered(pieces(batches)), schema)


def key_schema(flow) -> str:
    return "".join(f"`{k}` {flow.df.schema[k].dataType.simpleString()}, " for k in flow.by)
