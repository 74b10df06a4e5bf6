"""Buffers and windows by count, by time and by overlap."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..errors import Overflow
from ._stream import by_group, groups, in_groups, key_schema

#: Positions in a block of a sliding window without keys.
SLIDING_BLOCK = 1 << 16


def alike(left: list[str], right: list[str]) -> Column:
    """Whether keys are equal, nulls to nulls."""
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def listed(value: Column, order: list[str]) -> Column:
    """The values in order, as an aggregate."""
    pairs = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("__v"))))
    return F.transform(pairs, lambda p: p["__v"])


class Windows:
    def window_rows(self, size: int, skip: int | None = None, name: str = "window_id") -> DataFrame:
        """Items with the ids (from 0) of the count windows that hold them: window k holds positions k*skip+1 to k*skip+size."""
        skip = size if skip is None else skip
        if size < 1 or skip < 1:
            raise ValueError("size and skip must be positive")
        at = self.with_pos("pos")
        if skip >= size:
            k = F.floor((F.col("pos") - 1) / skip).cast("long")
            return at.withColumn(name, k).where(F.col("pos") - F.col(name) * skip <= size)
        low = F.greatest(F.lit(0), F.ceil((F.col("pos") - size) / skip)).cast("long")
        return at.withColumn(name, F.explode(F.sequence(low, F.floor((F.col("pos") - 1) / skip).cast("long"))))

    def buffer(self, value: str | Column, size: int, skip: int | None = None) -> DataFrame:
        """Lists of `size` items, a new one every `skip`; open lists are emitted at the end. Columns: keys, window_id, items."""
        col = F.col(value) if isinstance(value, str) else value
        return self.window_rows(size, skip).groupBy(*self.by, "window_id").agg(listed(col, self.order).alias("items"))

    def sliding(self, value: str | Column, size: int) -> DataFrame:
        """All full windows with step 1, then one list of the last size-1 items; one list of all if there are fewer."""
        if size < 1:
            raise ValueError("size must be positive")
        col = F.col(value) if isinstance(value, str) else value
        rows = self.with_pos("__pos").select(*self.by, "__pos", F.struct(col.alias("v")).alias("__v"))
        parts, own = self.by, F.lit(True)
        if not self.by:
            # blocks of positions; the first rows of each are copied to the block before, whose last windows reach into them
            block = max(size, SLIDING_BLOCK)
            at = F.floor((F.col("__pos") - 1) / block)
            reaches = (at > 0) & ((F.col("__pos") - 1) % block < size - 1)
            rows = rows.withColumn("__block", F.explode(F.when(reaches, F.array(at, at - 1)).otherwise(F.array(at))))
            parts, own = ["__block"], F.floor((F.col("__pos") - 1) / block) == F.col("__block")
        ahead = Window.partitionBy(*parts).orderBy("__pos").rowsBetween(0, size - 1)
        found = rows.withColumn("__items", F.collect_list("__v").over(ahead)).where(own)
        # the last full window is followed by one partial one; in a short group the first window holds all
        kept = found.where((F.size("__items") >= size - 1) | (F.col("__pos") == 1))
        return kept.select(*self.by, (F.col("__pos") - 1).alias("window_id"), F.transform("__items", lambda i: i["v"]).alias("items"))

    def time_windows(self, every: str, start: str | None = None, empty: bool = True) -> DataFrame:
        """Fixed-rate windows from the group's first time (or `start`): keys, window_start, n; empty ones are there with n = 0."""
        if not self.ts:
            raise ValueError("the flow has no time column")
        t = F.col(self.ts).cast("timestamp")
        step = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {every}"))
        timed = self.df.select(*self.by, F.unix_micros(t).alias("__us")).where("__us IS NOT NULL")
        if start:
            first = F.unix_micros(F.lit(start).cast("timestamp"))
            base = timed.where(F.col("__us") >= first).withColumn("__t0", first)
        elif self.by:
            bounds = timed.groupBy(*self.by).agg(F.min("__us").alias("__t0")).select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(self.by)], "__t0")
            base = timed.join(bounds, alike(self.by, [f"__b{i}" for i in range(len(self.by))]))
        else:
            base = timed.crossJoin(F.broadcast(timed.agg(F.min("__us").alias("__t0"))))
        counted = base.groupBy(*self.by, "__t0", F.floor((F.col("__us") - F.col("__t0")) / step).cast("long").alias("__k")).agg(F.count("*").alias("__n"))
        if empty:
            # a window brings the empty ones before it: of the group's windows, not of its items
            before = F.coalesce(F.lag("__k").over(Window.partitionBy(*self.by).orderBy("__k")), F.lit(-1).cast("long"))
            filled = counted.withColumn("__at", before).withColumn("__at", F.explode(F.sequence(F.col("__at") + 1, F.col("__k"))))
            counted = filled.withColumn("__n", F.when(F.col("__at") == F.col("__k"), F.col("__n")).otherwise(F.lit(0).cast("long"))).withColumn("__k", F.col("__at"))
        return counted.select(*self.by, F.timestamp_micros(F.col("__t0") + F.col("__k") * step).alias("window_start"), F.col("__n").alias("n"))

    def buffer_for(self, seconds: float, size: int | None = None, name: str = "buffer_id") -> DataFrame:
        """Buffers that start at the first item after a flush and hold items for less than `seconds`, and at most `size` items: the items with their buffer's id.

        State is one anchor a group, kept while a group's sorted rows stream through; a group's buffers are inherently sequential. An
        item without a time joins the open buffer; the buffer that it opens lasts from its first item with a time.
        """
        if not self.ts:
            raise ValueError("the flow has no time column")
        if size is not None and size < 1:
            raise ValueError("size must be positive")
        limit, long = size or (1 << 62), round(seconds * 1_000_000)
        names, by = [c for c in self.df.columns if c != name], self.by
        sorted_ = in_groups(self, self.df).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], F.unix_micros(F.col(self.ts).cast("timestamp")).alias("__us"), *names)

        def run(batches):
            anchor, held, k = None, 0, -1
            for begins, piece in groups(batches, len(by)):
                if begins:
                    anchor, held, k = None, 0, -1
                ids = []
                for t in piece.column(len(by)).to_pylist():
                    if k < 0 or held >= limit or t is not None and anchor is not None and t >= anchor + long:
                        anchor, held, k = t, 0, k + 1
                    elif anchor is None:
                        anchor = t
                    held += 1
                    ids.append(k)
                yield pa.RecordBatch.from_arrays([*piece.columns[len(by) + 1 :], pa.array(ids, pa.int64())], names=[*names, name])

        kept = self.df.select(*names).schema.fields
        return sorted_.mapInArrow(run, StructType([*kept, StructField(name, LongType())]))

    def overflow(self, value: str, seconds: float, n: int, capacity: int, strategy: str = "buffer") -> DataFrame:
        """A consumer that takes n items every so many seconds, behind a queue of `capacity`: keys, pos, the tick at which the item is taken, value.

        Ticks count from the group's first time; an item without a time comes right after the one before. An item that comes at a tick is queued after the consumer has taken from the queue. An item
        that finds the queue full fails the flow (buffer), is lost (drop), or takes the place of the oldest queued one (latest). What is queued at
        the end is taken by the ticks that follow. State is a queue a group, while its sorted rows stream through.
        """
        if n < 1 or capacity < 1 or seconds <= 0 or strategy not in ("buffer", "drop", "latest"):
            raise ValueError(f"{n}, {capacity}, {seconds}, {strategy}")
        every = round(seconds * 1_000_000)

        def take(state, upto):
            """What the consumer takes at its ticks before `upto` (None: until the queue is empty)."""
            out = []
            while state["queue"] and (upto is None or state["tick"] < upto):
                state["tick"] += 1
                for _ in range(min(n, len(state["queue"]))):
                    pos, v = state["queue"].popleft()
                    out.append((pos, state["tick"], v))
            state["tick"] = state["tick"] if upto is None else max(state["tick"], upto)
            return out

        def step(state, item):
            if item["us"] is not None and state["first"] is None:
                state["first"] = item["us"]
            out = [] if item["us"] is None else take(state, (item["us"] - state["first"]) // every)
            state["pos"] += 1
            if len(state["queue"]) == capacity:
                if strategy == "buffer":
                    raise Overflow(f"more than {capacity} items wait")
                if strategy == "drop":
                    return state, out
                state["queue"].popleft()
            state["queue"].append((state["pos"], item["v"]))
            return state, out

        kind = self.df.schema[value].dataType.simpleString()
        timed = self.like(self.df.withColumn("__item", F.struct(F.unix_micros(F.col(self.ts).cast("timestamp")).alias("us"), F.col(value).alias("v"))))
        start = lambda: {"first": None, "tick": 0, "pos": 0, "queue": deque()}
        return by_group(timed, start, step, f"{key_schema(self)}pos long, tick long, `{value}` {kind}", "__item", lambda state: take(state, None))

    def keep_last_per(self, every: str) -> DataFrame:
        """Overflow by keeping the latest: the last item of each time window."""
        return self._per_window(every, self.desc(), 1)

    def drop_beyond(self, every: str, n: int) -> DataFrame:
        """Overflow by dropping: the first n items of each time window."""
        return self._per_window(every, self.asc(), n)

    def _per_window(self, every: str, order: list[Column], n: int):
        w = Window.partitionBy(*self.by, "__w").orderBy(*order)
        df = self.df.withColumn("__w", F.window(F.col(self.ts).cast("timestamp"), every)["start"]).withColumn("__n", F.row_number().over(w))
        return self.like(df.where(F.col("__n") <= n).drop("__w", "__n"))
