"""Flows from literals, ranges, generators, recurrences, repetitions and replays."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..flow import Flow
from ..policies import Uni


def items(spark: SparkSession, values: Iterable, kind: str, name: str = "item") -> Flow:
    """Literal items in order, with pos from 1."""
    return Flow(spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], f"pos long, {name} {kind}"), "pos")


def optional(spark: SparkSession, value, kind: str) -> Flow:
    return items(spark, [] if value is None else [value], kind)


def empty(spark: SparkSession, kind: str = "int") -> Flow:
    return items(spark, [], kind)


def range_(spark: SparkSession, start: int, end: int) -> Flow:
    """Integers from start up to end, which is not one of them."""
    if end < start:
        raise ValueError("the end must not be before the start")
    return Flow(spark.range(start, end).select((F.col("id") - start + 1).alias("pos"), F.col("id").cast("int").alias("item")), "pos")


def failure(spark: SparkSession, message: str, kind: str = "int") -> Flow:
    """Fails at the first action."""
    return Flow(spark.range(1).select(F.lit(1).cast("long").alias("pos"), F.raise_error(F.lit(message)).cast(kind).alias("item")), "pos")


class Deferred:
    """A pipeline that is built anew for whatever is done with it; it offers what the flow offers."""

    def __init__(self, build: Callable[..., Flow], context: dict | None = None):
        self._build, self._context = build, context

    def flow(self) -> Flow:
        return self._build() if self._context is None else self._build(self._context)

    def __getattr__(self, name: str):
        return getattr(self.flow(), name)

    def __iter__(self):
        return iter(self.flow())


def deferred(build: Callable[[], Flow]) -> Deferred:
    """build() is called at each use."""
    return Deferred(build)


def with_context(build: Callable[[dict], Flow], context: dict) -> Deferred:
    """build(context) is called at each use; what it puts into the context is there the next time."""
    return Deferred(build, context)


def ticks(spark: SparkSession, start: str, end: str, every: str) -> Flow:
    """0, 1, 2, ... at a fixed rate between two times; for streams see streaming.ticks."""
    at = F.explode(F.sequence(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"), F.expr(f"INTERVAL {every}")))
    base = spark.range(1).select(at.alias("ts"))
    first = F.unix_micros(F.lit(start).cast("timestamp"))
    step = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {every}"))
    return Flow(base.select("ts", ((F.unix_micros("ts") - first) / step).cast("long").alias("tick")), "tick", ts="ts")


def generator(spark: SparkSession, state, step: Callable, kind: str, at_most: int | None = None) -> Flow:
    """A pull-based unfold: step(state) gives (state, items) or None at the end.

    Runs in one task, which sends items on as they come and holds those of one step. The end is step's alone: an unfold that
    never ends needs at_most, which keeps just so many items.
    """

    def unfold(start):
        s = start
        while (got := step(s)) is not None:
            s, out = got
            yield from out

    def numbered(start):
        return enumerate(islice(unfold(start), at_most), 1)

    return Flow(spark.createDataFrame(spark.sparkContext.parallelize([state], 1).flatMap(numbered), f"pos long, item {kind}"), "pos")


def recurrence(spark: SparkSession, sql: str, name: str = "pos") -> Flow:
    """A recurrence as WITH RECURSIVE text whose result has the order column."""
    return Flow(spark.sql(sql), name)


def repeat_at_most(flow: Flow, n: int, name: str = "turn") -> Flow:
    """The flow n times over."""
    if n < 1:
        raise ValueError("at least once")
    turns = flow.df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))
    return flow.like(flow.df.crossJoin(F.broadcast(turns)), order=[name, *flow.order])


def repeat_until(pages: Flow, stop) -> Flow:
    """Pages until one matches; that one is not given."""
    return pages.take_while(~F.coalesce(stop, F.lit(False)))


def repeat_whilst(pages: Flow, go_on) -> Flow:
    """Pages as long as they match, and the first that does not."""
    kept = pages.take_while(go_on)
    return pages.like(kept.df.unionByName(pages.skip_where(go_on).first(1).df))


def replay(flow: Flow, last: int | None = None, seed: Flow | None = None) -> Flow:
    """What a late subscriber gets: all items or the last ones, after the seed's. The items are kept for the next one, until release()."""
    kept = flow.cache()
    out = kept if last is None else kept.last(last)
    out = out if seed is None else seed.concat(out)
    out.release = kept.release
    return out


def from_any(spark: SparkSession, source, order="pos", kind: str = "int") -> Flow:
    """A DataFrame, a flow, a deferred one, a Uni, a future of any of these, any iterable, or a single value; None is an empty flow."""
    if hasattr(source, "result"):
        source = source.result()
    if isinstance(source, Uni):
        source = source.wait()
    if isinstance(source, Deferred):
        source = source.flow()
    if isinstance(source, Flow):
        return source
    if source is None or isinstance(source, str | bytes | dict) or not isinstance(source, Iterable | DataFrame):
        return optional(spark, source, kind)
    if isinstance(source, DataFrame):
        return Flow(source, order)
    return items(spark, source, kind)


def table(spark: SparkSession, path: str, order, by=(), ts: str | None = None, format: str = "parquet", **options) -> Flow:
    """A table as a flow; columns and filters are pushed down to its scan."""
    return Flow(spark.read.format(format).options(**options).load(path), order, by, ts)
