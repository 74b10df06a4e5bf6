"""Scans, folds and gatherers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ordinal import SCANS
from ._stream import by_group, key_schema
from .windows import listed

#: Items of a stretch that is folded in one row.
FOLD_CHUNK = 4096


@dataclass
class Gatherer:
    """A stateful transducer. extract(state, completed) gives None or (state, item), asked once an item and until None at the end."""

    start: Callable[[], Any]
    accumulate: Callable[[Any, Any], Any]
    extract: Callable[[Any, bool], tuple[Any, Any] | None]
    finish: Callable[[Any], Any | None] = lambda state: None


class Folds:
    def scan_native(self, name: str, aggregate: Column):
        """A running aggregate such as F.sum(x) in each group: for associative scans. Without keys it is one window and so one task; scan_with is not."""
        return self.like(self.df.withColumn(name, aggregate.over(self.running())))

    def scan_with(self, value: str | Column, how: str, name: str = "scan"):
        """A running sum, count, min, max or last non-null value, also over a whole flow without keys."""
        return self.like(self.running_all(**{name: (how, F.col(value) if isinstance(value, str) else value)}))

    def scan_seeded(self, value: str, seed, aggregate: Callable[[str], Column] | str, name: str = "scan") -> DataFrame:
        """The seed first, then the running aggregate over seed and items: keys, pos (from 0), scan. Groups without items have no seed row; a flow without keys has.

        aggregate is a function of a column, or sum, min or max by name; by name a flow without keys is scanned range by range.
        """
        kind = self.df.schema[value].dataType
        if isinstance(aggregate, str):
            how = aggregate
            at = self.like(self.with_pos("__pos")).running_all(__scan=(how, F.col(value)))
            found = SCANS[how][2](F.lit(seed).cast(at.schema["__scan"].dataType), F.col("__scan"))
            rows = at.select(*self.by, F.col("__pos").alias("pos"), found.alias(name))
            zero = [F.lit(0).cast("long").alias("pos"), F.lit(seed).cast(rows.schema[name].dataType).alias(name)]
            seeds = self.df.select(*self.by).distinct().select(*self.by, *zero) if self.by else self.df.sparkSession.range(1).select(*zero)
            return rows.unionByName(seeds)
        rows = self.with_pos("pos").select(*self.by, "pos", F.col(value).alias(name))
        first = F.lit(seed).cast(kind).alias(name)
        zero = F.lit(0).cast("long").alias("pos")
        seeds = rows.select(*self.by).distinct().select(*self.by, zero, first) if self.by else self.df.sparkSession.range(1).select(zero, first)
        from pyspark.sql import Window

        w = Window.partitionBy(*self.by).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        return rows.unionByName(seeds).withColumn(name, aggregate(name).over(w))

    def scan(self, value: str, fn: Callable, kind: str, seed=None, emit_seed: bool = True, name: str = "scan") -> DataFrame:
        """An opaque running fold: keys, pos, scan. Without seed the first item is the first state; with one it is emitted first, at pos 0."""
        missing = object()

        def start():
            return (0, missing if seed is None else seed)

        def step(state, v):
            n, acc = state
            out = [(0, seed)] if n == 0 and seed is not None and emit_seed else []
            acc = v if acc is missing else fn(acc, v)
            if acc is None:
                raise ValueError("a scan gave null")
            return (n + 1, acc), [*out, (n + 1, acc)]

        def finish(state):
            return [(0, seed)] if state[0] == 0 and seed is not None and emit_seed else []

        return by_group(self, start, step, f"{key_schema(self)}pos long, {name} {kind}", value, finish)

    def fold(self, value: str, seed: Column, merge: Callable[[Column, Column], Column], name: str = "fold", combine: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """One result a group, from the ordered items, as an expression.

        Without `combine` a group's items have to fit in one row. combine(state, state) of two neighbouring stretches lets stretches of
        FOLD_CHUNK items be folded first, each from the seed, and their states after that.
        """
        if combine is not None:
            at = self.with_pos("__pos").withColumn("__chunk", F.floor((F.col("__pos") - 1) / FOLD_CHUNK))
            parts = at.groupBy(*self.by, "__chunk").agg(listed(F.col(value), ["__pos"]).alias("__items")).select(*self.by, "__chunk", F.aggregate("__items", seed, merge).alias("__state"))
            states = listed(F.col("__state"), ["__chunk"]).alias("__states")
            every = parts.groupBy(*self.by).agg(states) if self.by else parts.agg(states)
            return every.select(*self.by, F.coalesce(F.reduce(F.slice("__states", 2, F.greatest(F.size("__states"), F.lit(1))), F.get("__states", F.lit(0)), combine), seed).alias(name))
        items = listed(F.col(value), self.order).alias("__items")
        lists = self.df.groupBy(*self.by).agg(items) if self.by else self.df.agg(items)
        return lists.select(*self.by, F.aggregate("__items", seed, merge).alias(name))

    def gather(self, value: str, gatherer: Gatherer, kind: str, name: str = "item") -> DataFrame:
        """A user's transducer: keys, seq (from 1), item."""
        g = gatherer

        def out(state, n, items):
            if any(i is None for i in items):
                raise ValueError("a gatherer gave null")
            return (state, n + len(items)), [(n + 1 + k, i) for k, i in enumerate(items)]

        def step(state, v):
            acc, n = g.accumulate(state[0], v), state[1]
            got = g.extract(acc, False)
            return out(acc, n, []) if got is None else out(got[0], n, [got[1]])

        def finish(state):
            acc, n = state
            items = []
            while (got := g.extract(acc, True)) is not None:
                acc = got[0]
                items.append(got[1])
            last = g.finish(acc)
            return out(acc, n, items + ([] if last is None else [last]))[1]

        return by_group(self, lambda: (g.start(), 0), step, f"{key_schema(self)}seq long, {name} {kind}", value, finish)

    def gather_scan(self, value: str, fn: Callable, seed, kind: str, name: str = "item") -> DataFrame:
        """A running fold without the seed, whose last state comes twice; an empty flow gives the seed."""
        fresh = object()
        g = Gatherer(lambda: (seed, fresh), lambda s, v: (fn(s[0], v), True), lambda s, done: None if s[1] is fresh else ((s[0], fresh), s[0]), lambda s: s[0])
        return self.gather(value, g, kind, name)
