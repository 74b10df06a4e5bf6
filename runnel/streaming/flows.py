"""Flows over Structured Streaming: event-time windows, deduplication, stateful buffers, pacing and sinks.

Time columns become timestamps (a watermark needs them). A stream has no end: what would be emitted at the end of a batch
flow (open buffers, last windows) is emitted when the watermark passes, or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..errors import Overflow
from ..ordinal import numbered

#: Rows from which the small parts of a batch are cut, about; they are one partition.
BLOCK = 1 << 16


def events(spark: SparkSession, folder: str, glob: str, schema, ts: str, late: str = "1 hour", files_per_trigger: int | None = None) -> DataFrame:
    """A stream over Parquet files with a watermark; files_per_trigger bounds what a trigger takes."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def ticks(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """0, 1, 2, ... in `value`, with the time in `timestamp`."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def hot(df: DataFrame, ts: str, joined: str) -> DataFrame:
    """What a subscriber gets that joins a running stream: only items from then on."""
    return df.where(F.col(ts) >= F.lit(joined).cast("timestamp"))


def listen(spark: SparkSession, on_start: Callable | None = None, on_progress: Callable | None = None, on_end: Callable | None = None):
    """Lifecycle hooks of streaming queries; returns the listener, to be removed by spark.streams.removeListener."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Hooks(StreamingQueryListener):
        def onQueryStarted(self, event):
            if on_start:
                on_start(event)

        def onQueryProgress(self, event):
            if on_progress:
                on_progress(event)

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            if on_end:
                on_end(event)

    hooks = Hooks()
    spark.streams.addListener(hooks)
    return hooks


def tumbling(df: DataFrame, ts: str, every: str, by: list[str], slide: str | None = None, **aggregates) -> DataFrame:
    """Windows of event time; closed ones are final."""
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return df.groupBy(w, *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(*by, F.col("window.start").alias("window_start"), *aggregates)


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], **aggregates) -> DataFrame:
    """Sessions that end with a gap: the inactivity timeout of a stream."""
    w = F.session_window(ts, gap)
    return df.groupBy(w, *by).agg(*[c.alias(n) for n, c in aggregates.items()]).select(*by, F.col("session_window.start").alias("window_start"), F.col("session_window.end").alias("window_end"), *aggregates)


def distinct(df: DataFrame, *keys: str) -> DataFrame:
    """The first item of each key, remembered as long as the watermark allows."""
    return df.dropDuplicatesWithinWatermark(list(keys))


class _Buffers(StatefulProcessor):
    """Buffers of at most `size` items and `seconds` of event time since their first item; timers flush what is left."""

    size, seconds, value, ts, kind, key = 0, 0.0, "", "", "double", ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", f"at double, v {self.kind}")

    def _flush(self, key, rows):
        import pandas as pd

        self.items.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        return pd.DataFrame([{self.key: key[0], "n": len(rows), "items": [v for _, v in rows]}])

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        held = sorted((r[0], r[1]) for r in self.items.get())
        for f in rows:
            times = f[self.ts].astype("datetime64[us]").astype("int64") / 1e6
            for at, v in sorted(zip(times.tolist(), f[self.value].tolist(), strict=True)):
                if held and at >= held[0][0] + self.seconds:
                    yield self._flush(key, held)
                    held = []
                held.append((at, v))
                if len(held) >= self.size:
                    yield self._flush(key, held)
                    held = []
        if held:
            self.items.put(held)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((held[0][0] + self.seconds) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        held = sorted((r[0], r[1]) for r in self.items.get())
        if held:
            yield self._flush(key, held)

    def close(self) -> None:
        pass


def buffers(df: DataFrame, key: str, ts: str, value: str, size: int, seconds: float) -> DataFrame:
    """key, n, items: lists flushed by size, by time since their first item, or by the watermark."""
    kind = df.schema[value].dataType.simpleString()
    made = type("Buffers", (_Buffers,), {"size": size, "seconds": seconds, "value": value, "ts": ts, "kind": kind, "key": key})
    schema = f"{key} {df.schema[key].dataType.simpleString()}, n int, items array<{kind}>"
    return df.select(key, ts, value).groupBy(key).transformWithStateInPandas(statefulProcessor=made(), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def sink(df: DataFrame, path: str, checkpoint: str, every: str | None = None, mode: str = "append") -> StreamingQuery:
    """Writes a stream as Parquet, exactly once; `every` paces it, without it all that is there is taken and the query ends."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _in_parts(df: DataFrame, n: int, cap: int, order: Sequence[str], take: Callable[[DataFrame], None]) -> None:
    """Calls take with one `cap` of df's n rows after another, in the order. The rows are numbered once and kept instead of df.

    Small parts are cut from blocks, each kept in one partition with its rows in order: a part costs a task over a block, and only a block
    costs tasks over the whole batch.
    """
    # A decimal stays out of the code that Spark compiles, where a long is written into it: so all parts share theirs.
    kind, parts, per = "decimal(19, 0)", -(-n // cap), BLOCK // cap
    at = numbered(df, order, "__pos").withColumn("__part", F.expr(f"(__pos - 1) div {cap}").cast(kind)).persist()
    number = lambda i: F.lit(Decimal(i)).cast(kind)
    part = lambda rows, i: rows.where(F.col("__part") == number(i)).drop("__pos", "__part")
    try:
        at.count()
        df.unpersist()
        for first in range(0, parts, max(per, 1)):
            if per < 2:
                take(part(at, first))
                continue
            last = min(first + per, parts) - 1
            block = at.where(F.col("__part").between(number(first), number(last))).repartition(1).sortWithinPartitions("__pos").persist()
            try:
                for i in range(first, last + 1):
                    take(part(block, i))
            finally:
                block.unpersist()
    finally:
        at.unpersist()


def each_batch(
    df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, capacity: int | None = None, mode: str = "append",
    cap: int | None = None, order: Sequence[str] = (),
) -> StreamingQuery:
    """Calls fn for each micro-batch (it has to be idempotent by batch id); more rows than `capacity` in one are an overflow.

    cap: fn is asked to take so many rows at a time at most, in the order of the columns `order`; all parts of a batch have its id. With a
    capacity or a cap the batch is kept while it is counted and taken, so that its plan runs once.
    """
    if cap is not None and (cap < 1 or not order):
        raise ValueError("a cap has to be positive, and to be taken in an order")

    def run(batch: DataFrame, number: int) -> None:
        if capacity is None and cap is None:
            return fn(batch, number)
        kept = batch.persist()
        try:
            n = kept.count()
            if capacity is not None and n > capacity:
                raise Overflow(f"{n} items for {capacity}")
            if cap is None:
                return fn(kept, number)
            _in_parts(kept, n, cap, order, lambda part: fn(part, number))
        finally:
            kept.unpersist()

    writer = df.writeStream.foreachBatch(run).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


class Pausable:
    """A stream that can be paused and resumed: its query stops, and starts again from its checkpoint.

    What comes in the meantime waits in the source and is taken on resumption (buffer), or is passed over (drop).
    """

    def __init__(self, df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, strategy: str = "buffer", paused: bool = False):
        if strategy not in ("buffer", "drop"):
            raise ValueError(strategy)
        self._df, self._fn, self._at, self._every, self._strategy = df, fn, checkpoint, every, strategy
        self.query: StreamingQuery | None = None
        self._was_paused = False
        if not paused:
            self.resume()

    @property
    def paused(self) -> bool:
        return self.query is None

    def pause(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query, self._was_paused = None, True

    def resume(self) -> None:
        if self.query is not None:
            return
        if self._strategy == "drop" and self._was_paused:
            each_batch(self._df, lambda batch, number: None, self._at).awaitTermination()
        self.query = each_batch(self._df, self._fn, self._at, self._every)

    def wait(self, seconds: float | None = None) -> bool:
        """Whether what is there has been taken, for a stream without a trigger of its own."""
        return self.query is None or bool(self.query.awaitTermination(seconds) if seconds else self.query.awaitTermination() or True)


def split(df: DataFrame, key: str, routes: dict[str, Callable[[DataFrame, int], None]], checkpoint: str) -> StreamingQuery:
    """One pass over a stream for several consumers by key."""

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for k, fn in routes.items():
            fn(kept.where(F.col(key) == k), number)
        kept.unpersist()

    return each_batch(df, run, checkpoint)
