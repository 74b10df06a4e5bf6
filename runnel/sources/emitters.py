"""Python data sources: an emitter that pushes items, a source that never does, resources that are closed."""

from __future__ import annotations

import inspect
import pickle
from base64 import b64decode, b64encode
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..errors import Overflow
from ..flow import Flow

#: Items that a stream takes from its emitter at a trigger, unless told otherwise.
CAPACITY = 1 << 16
STRATEGIES = ("buffer", "drop", "latest", "error")


class _Emitter(DataSource):
    @classmethod
    def name(cls) -> str:
        return "runnel_emitter"

    def schema(self) -> str:
        return self.options["kind"]

    def reader(self, schema):
        return _Reader({k: _load(self.options[k]) for k in ("emit", "open", "done", "failed", "cancelled") if k in self.options})

    def simpleStreamReader(self, schema):
        return _StreamReader(_load(self.options["emit"]), self.options["strategy"], int(self.options["capacity"]))


def _load(text: str):
    return pickle.loads(b64decode(text))


class _Reader(DataSourceReader):
    def __init__(self, fns: dict[str, Callable]):
        self.fns = fns

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        """Items in the order they are pushed; the resource is closed whether they end, fail, or are no longer asked for."""
        fns = self.fns
        given = [fns["open"]()] if "open" in fns else []

        def close(how: str, *args):
            if how in fns:
                fns[how](*given, *args)

        try:
            for i, x in enumerate(fns["emit"](*given)):
                yield (i + 1, x)
        except GeneratorExit:
            close("cancelled")
            raise
        except Exception as e:
            close("failed", e)
            raise
        close("done")


class _StreamReader(SimpleDataSourceStreamReader):
    """Offsets count the items emitted; the emitter goes on where it was, and no more than `capacity` items are held."""

    def __init__(self, emit: Callable, strategy: str, capacity: int):
        self.emit, self.strategy, self.capacity = emit, strategy, capacity
        self.takes_offset = bool(inspect.signature(emit).parameters)
        self.source: Iterator | None = None
        self.at = 0

    def _from(self, at: int) -> Iterator:
        """What is emitted from item number `at` on."""
        if self.source is None or self.at != at:
            self.source, self.at = (iter(self.emit(at)) if self.takes_offset else islice(self.emit(), at, None)), at
        return self.source

    def _kept(self, start: int, end: int) -> range:
        """The items of start to end that the strategy lets through: a function of the offsets alone, so that a trigger can be run again."""
        if self.strategy == "drop":
            return range(start, min(end, start + self.capacity))
        return range(max(start, end - self.capacity), end) if self.strategy == "latest" else range(start, end)

    def initialOffset(self):
        return {"at": 0}

    def read(self, start: dict):
        at, held = start["at"], deque(maxlen=self.capacity if self.strategy == "latest" else None)
        source, end = self._from(at), at
        for x in source:
            end += 1
            if self.strategy != "drop" or end - at <= self.capacity:
                if self.strategy == "error" and end - at > self.capacity:
                    raise Overflow(f"more than {self.capacity} items wait")
                held.append(x)
            if self.strategy == "buffer" and end - at == self.capacity:
                self.at = end
                break
        else:
            self.source = None  # all that is there so far; asked anew at the next trigger
        kept = self._kept(at, end)
        return iter([(i + 1, x) for i, x in zip(kept, held, strict=True)]), {"at": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        kept = self._kept(start["at"], end["at"])
        first = self.emit(kept.start) if self.takes_offset else islice(self.emit(), kept.start, None)
        return iter([(i + 1, x) for i, x in zip(kept, first)])

    def commit(self, end: dict):
        pass


def _text(fn: Callable) -> str:
    from pyspark import cloudpickle

    return b64encode(cloudpickle.dumps(fn)).decode()


def emitter(
    spark: SparkSession, emit: Callable, kind: str, opened: Callable | None = None, closed: Callable | None = None,
    on_failure: Callable | None = None, on_cancellation: Callable | None = None,
) -> Flow:
    """A flow of what emit() yields. With `opened`, of what emit(resource) yields, the resource being given to one finalizer at the end:

    closed(resource) when the items end, on_failure(resource, failure) when emitting fails, on_cancellation(resource) when no more items are
    asked for; each is `closed` by default.
    """
    spark.dataSource.register(_Emitter)
    closing = {"done": closed, "failed": on_failure or (closed and (lambda *a: closed(*a[:-1]))), "cancelled": on_cancellation or closed}
    fns = {"emit": emit, "open": opened} | closing
    options = {"kind": f"pos long, item {kind}"} | {k: _text(f) for k, f in fns.items() if f}
    return Flow(spark.read.format("runnel_emitter").options(**options).load(), "pos")


def stream(spark: SparkSession, emit: Callable, kind: str, strategy: str = "buffer", capacity: int = CAPACITY) -> DataFrame:
    """A streaming DataFrame of what emit() yields so far at each trigger; emit(n), if it takes a number, yields the items from number n on.

    When more than `capacity` items are there at a trigger: the rest waits for the next (buffer), is lost (drop), takes the place of
    the older ones (latest), or the stream fails (error).
    """
    if strategy not in STRATEGIES or capacity < 1:
        raise ValueError(f"{strategy}, {capacity}")
    spark.dataSource.register(_Emitter)
    return spark.readStream.format("runnel_emitter").options(kind=f"pos long, item {kind}", emit=_text(emit), strategy=strategy, capacity=str(capacity)).load()


def never(spark: SparkSession, kind: str = "int") -> DataFrame:
    """A stream without items and without an end."""
    return stream(spark, lambda: [], kind)
