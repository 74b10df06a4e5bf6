"""Per-item transforms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, LongType, StructField, StructType

from .windows import alike


def no_null(c: Column, what: str) -> Column:
    """A mapping must not give null: the flow fails at the first action."""
    return F.when(c.isNotNull(), c).otherwise(F.raise_error(F.lit(f"{what} gave null")))


class Split(dict):
    """The flows of a split by their keys."""

    def __init__(self, flows: dict, df: DataFrame):
        super().__init__(flows)
        self._df = df

    def release(self) -> None:
        self._df.unpersist()


class Transforms:
    def map(self, on_null: str = "fail", **columns: Column):
        """Adds or replaces columns. Null results: fail, keep, or drop the item."""
        if on_null not in ("fail", "keep", "drop"):
            raise ValueError(on_null)
        df = self.df.withColumns({n: no_null(c, n) if on_null == "fail" else c for n, c in columns.items()})
        return self.like(df.dropna(subset=list(columns)) if on_null == "drop" else df)

    def only(self, *columns: str | Column):
        """A projection; order, key and time columns stay."""
        kept = [c for c in dict.fromkeys([*self.by, *self.order, *([self.ts] if self.ts else [])])]
        names = [c for c in columns if not isinstance(c, str) or c not in kept]
        return self.like(self.df.select(*kept, *names))

    def filter(self, predicate: Column, limit: int | None = None):
        """Items for which the predicate is true; at most `limit` of each group."""
        out = self.like(self.df.where(F.coalesce(predicate, F.lit(False))))
        return out if limit is None else out.first(limit)

    def skip_where(self, predicate: Column):
        """Items for which the predicate is not true."""
        return self.like(self.df.where(~F.coalesce(predicate, F.lit(False))))

    def when(self, decisions: DataFrame, on: Sequence[str], negate: bool = False):
        """Items whose keys a decision table holds (or does not hold)."""
        return self.like(self.df.join(decisions, list(on), "left_anti" if negate else "left_semi"))

    def cast_to(self, **kinds: str):
        """Casts columns; under ANSI mode a value that does not fit fails."""
        return self.like(self.df.withColumns({n: F.col(n).cast(k) for n, k in kinds.items()}))

    def ignore(self):
        """No items, the same columns."""
        return self.like(self.df.where(F.lit(False)))

    def flat_map(self, items: Column, name: str, inner: str = "inner"):
        """One row an element of an array, outer then inner order; empty and null arrays give nothing."""
        cols = [c for c in self.df.columns if c not in (name, inner)]
        df = self.df.select(*cols, F.posexplode(items).alias(inner, name))
        return self.like(df, order=[*self.order, inner])

    def disjoint(self, column: str, inner: str = "inner"):
        """Flattens the column if it is an array; anything else passes as it is."""
        if self.df.schema[column].dataType.typeName() != "array":
            return self
        return self.flat_map(F.col(column), column, inner)

    def sub_flows(self, inner, on: Sequence[str], how: str = "concat", concurrency: int = 256, name: str = "inner"):
        """Each item becomes the sub-flow of those rows of the flow `inner` that equal it in the columns `on`, nulls being equal.

        A row is the outer item, the position `name` in the sub-flow, and the inner row as the struct `sub`. Concatenated, the order is outer,
        then inner; merged, each `concurrency` sub-flows take turns item by item.
        """
        if how not in ("concat", "merge") or concurrency < 1:
            raise ValueError(f"{how}, {concurrency}")
        keys = [f"__on{i}" for i in range(len(on))]
        sub = inner.group_by(*on).with_pos(name).select(*[F.col(c).alias(k) for c, k in zip(on, keys, strict=True)], name, F.struct(*inner.df.columns).alias("sub"))
        if how == "concat":
            return self.like(self.df.join(sub, alike(on, keys)).drop(*keys), order=[*self.order, name])
        outer = self.with_pos("__pos").withColumn("turn", F.floor((F.col("__pos") - 1) / concurrency)).drop("__pos")
        return self.like(outer.join(sub, alike(on, keys)).drop(*keys), order=["turn", name, *self.order])

    def concat_map(self, value: str, fn: Callable, kind: str, name: str = "item", inner: str = "inner"):
        """Each item becomes what fn(value) yields, an opaque function: outer, then inner order. Yielded items are sent on in batches, never held as a whole."""
        kept = [c for c in self.df.columns if c not in (name, inner)]
        df = self.df.select(*kept, F.col(value).alias("__value"))
        schema = StructType([*self.df.select(*kept).schema.fields, StructField(inner, LongType()), StructField(name, DataType.fromDDL(kind))])
        arrow = to_arrow_schema(schema)

        def run(batches):
            for batch in batches:
                rows, at, items = [], [], []

                def taken():
                    columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(kept)]]  # noqa: B023
                    return pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int64()), pa.array(items, arrow.types[-1])], names=schema.names)  # noqa: B023

                for row, v in enumerate(batch.column(len(kept)).to_pylist()):
                    for i, item in enumerate(fn(v)):
                        rows.append(row), at.append(i), items.append(item)
                        if len(rows) == 8192:
                            yield taken()
                            rows, at, items = [], [], []
                if rows:
                    yield taken()

        return self.like(df.mapInArrow(run, schema), order=[*self.order, inner])

    def invoke(self, fn: Callable, *columns: str):
        """Calls fn with the columns' values of each item, in the tasks; items pass unchanged. A task that runs again calls it again."""
        at = [self.df.columns.index(c) for c in columns]

        def run(batches):
            for batch in batches:
                for values in zip(*[batch.column(i).to_pylist() for i in at]):
                    fn(*values)
                yield batch

        return self.like(self.df.mapInArrow(run, self.df.schema))

    def pace(self, n: int, seconds: float, name: str = "released"):
        """A fixed demand of n items every so many seconds: the seconds after the start at which each item (of each group) is let through."""
        if n < 1 or seconds <= 0:
            raise ValueError("a demand and its delay must be positive")
        return self.like(self.with_pos("__pos").withColumn(name, F.floor((F.col("__pos") - 1) / n) * F.lit(float(seconds))).drop("__pos"))

    def enrich(self, lookup: DataFrame, on: Sequence[str], how: str = "left"):
        """Asynchronous one-to-one lookups as a join."""
        return self.like(self.df.join(lookup, list(on), how))

    def map_rows(self, fn: Callable, schema: str):
        """An opaque Python function over Arrow batches as pandas frames; order columns have to survive."""
        return self.like(self.df.mapInPandas(lambda frames: (fn(f) for f in frames), schema))

    def map_python(self, fn: Callable, name: str, kind: str, *columns: str):
        """A column from an opaque Python function of pandas series, for what no expression says."""
        return self.like(self.df.withColumn(name, F.pandas_udf(fn, kind)(*[F.col(c) for c in columns])))

    def log(self, name: str = "log", logger=None):
        """Logs the row count of the next action under the name; items pass unchanged."""
        import logging
        import threading

        seen = Observation(name)
        out = self.observe(seen, items=F.count(F.lit(1)))
        say = logger or logging.getLogger("runnel")
        threading.Thread(target=lambda: say.info("%s: %s", name, seen.get), daemon=True).start()
        return out

    def observe(self, name: str | Observation, **metrics: Column):
        """Side metrics of the next action; items pass unchanged."""
        return self.like(self.df.observe(name, *[c.alias(n) for n, c in metrics.items()]))

    def fail_with(self, message: str):
        """Any item is a failure."""
        first = self.df.columns[0]
        kind = self.df.schema[first].dataType
        return self.like(self.df.withColumn(first, F.raise_error(F.lit(message)).cast(kind)))

    def with_context(self, context: Mapping[str, str], name: str = "context"):
        """Each item with a literal map."""
        pairs = [F.lit(x) for kv in context.items() for x in kv]
        return self.like(self.df.withColumn(name, F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")))

    def split(self, key: Column, keys: Sequence[str], keep: bool = False) -> Split:
        """One flow a key; a null key or one that is not declared fails.

        Each flow reads the source by itself, with its key pushed down as a filter. keep: the source is read once, and its items are kept until the split is released.
        """
        checked = F.when(key.isin(list(keys)), key).otherwise(F.raise_error(F.concat(F.lit("undeclared key "), F.coalesce(key, F.lit("null")))))
        df = self.df.withColumn("__key", checked)
        df = df.persist() if keep else df
        return Split({k: self.like(df.where(F.col("__key") == k).drop("__key")) for k in keys}, df)

    def index(self, name: str = "index"):
        """The position from 0."""
        return self.like(self.with_pos("__pos").withColumn(name, F.col("__pos") - 1).drop("__pos"))
