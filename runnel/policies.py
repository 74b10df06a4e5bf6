"""Driver-side policies: single results, retry with back-off, timeouts, memoization, joins of results, sharing.

A Uni is a lazy thunk that is run anew at each await; it wraps one action or a value.
"""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from .errors import CompositeFlowError, FlowTimeout, NoSuchItem


def backoff_delays(first: float, longest: float = float("inf"), jitter: float = 0.5, seed: int | None = None):
    """Seconds to wait before each retry: the first doubled each time, spread by the jitter share, never less than the first nor more than the longest."""
    if not 0 <= jitter <= 1:
        raise ValueError("jitter is a share")
    rng, i = random.Random(seed), 0
    while True:
        base = min(longest, first * 2.0 ** min(i, 1000))
        yield min(longest, max(first, base + base * jitter * rng.uniform(-1, 1)))
        i += 1


def retry(action: Callable[[], Any], at_most: int | None = None, delays=None, until: Callable[[BaseException], bool] | None = None, expire_in: float | None = None, sleep=time.sleep):
    """Runs the action again after a failure: `at_most` times more, while until(failure) holds, and, with delays, before it expires.

    Rows that a failed action has written stay; write to a folder of the attempt and rename it, or to an idempotent sink.
    """
    if expire_in is not None and delays is None:
        raise ValueError("an expiry needs delays")
    end = None if expire_in is None else time.monotonic() + expire_in
    tries, waits = 0, iter(delays) if delays is not None else None
    while True:
        try:
            return action()
        except Exception as failure:
            if at_most is not None and tries >= at_most or until is not None and not until(failure):
                raise
            delay = next(waits, 0.0) if waits is not None else 0.0
            if end is not None and time.monotonic() + delay > end:
                raise
            tries += 1
            if delay:
                sleep(delay)


def within(spark, seconds: float, action: Callable[[], Any]):
    """The action's result, or FlowTimeout after so many seconds, its Spark jobs cancelled."""
    if seconds <= 0:
        raise ValueError("a duration must be positive")
    group, box = uuid.uuid4().hex, Future()

    def run():
        spark.sparkContext.setJobGroup(group, "within", interruptOnCancel=True)
        try:
            box.set_result(action())
        except BaseException as e:  # noqa: BLE001
            box.set_exception(e)

    t = InheritableThread(target=run, daemon=True)
    t.start()
    try:
        return box.result(seconds)
    except TimeoutError:
        if box.done():
            raise
        spark.sparkContext.cancelJobGroup(group)
        raise FlowTimeout(f"no result in {seconds} s") from None


class Uni:
    def __init__(self, thunk: Callable[[], Any]):
        self.thunk = thunk

    # -- creation

    @classmethod
    def item(cls, value: Any = None) -> Uni:
        return cls(value if callable(value) else lambda: value)

    @classmethod
    def failure(cls, error: BaseException | Callable[[], BaseException]) -> Uni:
        def fail():
            raise error() if callable(error) and not isinstance(error, BaseException) else error

        return cls(fail)

    @classmethod
    def first_of(cls, df: DataFrame) -> Uni:
        """The first row, or None."""
        return cls(df.first)

    @classmethod
    def defer(cls, supplier: Callable[..., Uni], context: dict | None = None) -> Uni:
        """supplier() is asked at each await; with a context, supplier(context)."""
        return cls(lambda: (supplier() if context is None else supplier(context)).thunk())

    @classmethod
    def nothing(cls) -> Uni:
        """Never ends; to be awaited with a time limit."""
        return cls(lambda: threading.Event().wait())

    @classmethod
    def emitter(cls, emit: Callable[[Callable, Callable], None]) -> Uni:
        """emit(complete, fail) calls one of its two arguments, from any thread; the first call counts."""

        def run():
            box: Future = Future()

            def settle(how: Callable, x):
                if not box.done():
                    how(x)

            emit(lambda x=None: settle(box.set_result, x), lambda e: settle(box.set_exception, e))
            return box.result()

        return cls(run)

    @classmethod
    def from_any(cls, source: Any) -> Uni:
        """A Uni, a future, a flow's or DataFrame's first row, or the first of any iterable; None if there is none."""
        if isinstance(source, Uni):
            return source
        if hasattr(source, "result"):
            return cls(source.result)
        if hasattr(source, "to_uni"):
            return source.to_uni()
        return cls.first_of(source) if isinstance(source, DataFrame) else cls(lambda: next(iter(source), None))

    # -- items

    def map(self, fn: Callable) -> Uni:
        return Uni(lambda: fn(self.thunk()))

    def flat_map(self, fn: Callable[[Any], Uni]) -> Uni:
        return Uni(lambda: fn(self.thunk()).thunk())

    def replace_with(self, value: Any) -> Uni:
        return self.map(lambda _: value)

    def invoke(self, fn: Callable) -> Uni:
        def run(x):
            fn(x)
            return x

        return self.map(run)

    def if_null(self, value: Any = None, error: BaseException | None = None) -> Uni:
        def run(x):
            if x is None and error is not None:
                raise error
            return value if x is None else x

        return self.map(run)

    def if_not_null(self, fn: Callable) -> Uni:
        return self.map(lambda x: None if x is None else fn(x))

    def delay(self, seconds: float) -> Uni:
        return self.invoke(lambda _: time.sleep(seconds))

    def delay_until(self, fn: Callable[[Any], Uni]) -> Uni:
        """The item, once fn of it has given a result."""
        return self.invoke(lambda x: fn(x).thunk())

    # -- its item ignored

    def and_fail(self, error: BaseException | Callable[[], BaseException]) -> Uni:
        return self.and_switch_to(Uni.failure(error))

    def and_switch_to(self, other: Uni | Callable[[], Uni]) -> Uni:
        return self.flat_map(lambda _: other if isinstance(other, Uni) else other())

    def and_continue_with(self, value: Any = None) -> Uni:
        return self.map(lambda _: value() if callable(value) else value)

    # -- hooks

    def hooked(self, **hooks: Callable) -> Uni:
        """With on_start, on_termination(failure or None) and on_cancel."""
        return Uni(lambda: hooked(self.thunk, **hooks))

    def eventually(self, fn: Callable[[], Any]) -> Uni:
        """fn() after the item or failure, which passes on."""

        def run():
            try:
                return self.thunk()
            finally:
                fn()

        return Uni(run)

    def pipe(self, fn: Callable[[Uni], Any], *args, **kwargs):
        return fn(self, *args, **kwargs)

    # -- to many items

    def to_multi(self, spark, kind: str):
        """A flow of the item, or of none if it is null."""
        return self.transform_to_multi(spark, lambda x: x, kind)

    def transform_to_multi(self, spark, fn: Callable[[Any], Any], kind: str = "int", order: str | Sequence[str] = "pos"):
        """The flow that fn makes of the item: a flow, a DataFrame in an order, an iterable, or a single value. Built and awaited at each use."""
        from .sources import create

        return create.Deferred(lambda: create.from_any(spark, fn(self.thunk()), order, kind))

    def disjoint(self, spark, kind: str):
        """A flow of the elements of the item."""
        return self.transform_to_multi(spark, lambda x: x if x is None else list(x), kind)

    # -- failures

    def recover_with(self, value: Any = None, on: type[BaseException] | Callable = Exception) -> Uni:
        def run():
            try:
                return self.thunk()
            except Exception as e:
                if not (isinstance(e, on) if isinstance(on, type) else on(e)):
                    raise
                return value.thunk() if isinstance(value, Uni) else value(e) if callable(value) else value

        return Uni(run)

    def map_failure(self, fn: Callable[[BaseException], BaseException]) -> Uni:
        def run():
            try:
                return self.thunk()
            except Exception as e:
                raise fn(e) from e

        return Uni(run)

    def either(self, fn: Callable[[Any, BaseException | None], Any]) -> Uni:
        """fn of the item, or of the failure."""

        def run():
            try:
                x = self.thunk()
            except Exception as e:
                return fn(None, e)
            return fn(x, None)

        return Uni(run)

    def retry(self, **how) -> Uni:
        return Uni(lambda: retry(self.thunk, **how))

    def within(self, spark, seconds: float) -> Uni:
        return Uni(lambda: within(spark, seconds, self.thunk))

    # -- results

    def memoize(self, seconds: float | None = None, until: Callable[[], bool] | None = None) -> Uni:
        """Runs once and keeps the result or failure; for so long, or until the guard says to run again."""
        lock, kept = threading.Lock(), {}

        def run():
            with lock:
                old = "at" in kept and (seconds is not None and time.monotonic() - kept["at"] >= seconds or until is not None and until())
                if "at" not in kept or old:
                    kept.clear()
                    try:
                        kept["value"] = self.thunk()
                    except Exception as e:
                        kept["error"] = e
                    kept["at"] = time.monotonic()
                if "error" in kept:
                    raise kept["error"]
                return kept["value"]

        return Uni(run)

    def repeat(self, at_most: int | None = None, until: Callable | None = None, whilst: Callable | None = None):
        """Evaluates again and again: `until` does not give the item that matches, `whilst` gives the item that fails."""
        n = 0
        while at_most is None or n < at_most:
            x = self.thunk()
            n += 1
            if until is not None and until(x):
                return
            yield x
            if whilst is not None and not whilst(x):
                return

    def wait(self, seconds: float | None = None, spark=None) -> Any:
        if seconds is None:
            return self.thunk()
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.active()
        return within(spark, seconds, self.thunk)

    def future(self, pool: ThreadPoolExecutor) -> Future:
        return pool.submit(self.thunk)


class _Race:
    """Unis that run side by side, each with a Spark job group of its own, so that those no longer needed can be stopped."""

    def __init__(self, unis: Sequence[Uni], concurrency: int | None = None):
        session = SparkSession.getActiveSession()
        self._context = None if session is None else session.sparkContext
        self._slots, self._over = threading.Semaphore(concurrency or len(unis)), threading.Event()
        self._groups = {uuid.uuid4().hex: Future() for _ in unis}
        self.futures = list(self._groups.values())
        for u, (group, box) in zip(unis, self._groups.items(), strict=True):
            InheritableThread(target=self._run, args=(u, group, box), daemon=True).start()

    def _run(self, u: Uni, group: str, box: Future) -> None:
        with self._slots:
            if self._over.is_set():
                box.cancel()
                return
            if self._context is not None:
                self._context.setJobGroup(group, "race", interruptOnCancel=True)
            try:
                box.set_result(u.thunk())
            except BaseException as e:  # noqa: BLE001
                box.set_exception(e)

    def stop(self) -> None:
        """Those that wait do not start; Spark jobs of those that run are cancelled."""
        self._over.set()
        for group, box in self._groups.items():
            if not box.done() and self._context is not None:
                self._context.cancelJobGroup(group)


def join_all(unis: Sequence[Uni], concurrency: int | None = None, collect_failures: bool = False) -> Uni:
    """All results in order. Fails at the first failure, the others being stopped, or with all failures at the end."""

    def run():
        if not unis:
            return []
        race = _Race(unis, concurrency)
        futures = race.futures
        try:
            if not collect_failures:
                pending = set(futures)
                while pending:
                    done, pending = wait(pending, return_when=FIRST_COMPLETED)
                    for f in futures:
                        if f in done and f.exception():
                            raise f.exception()
                return [f.result() for f in futures]
            wait(futures)
            errors = [f.exception() for f in futures if f.exception()]
            if len(errors) > 1:
                raise CompositeFlowError(errors)
            if errors:
                raise errors[0]
            return [f.result() for f in futures]
        finally:
            race.stop()

    return Uni(run)


def join_first(unis: Sequence[Uni], with_item: bool = False) -> Uni:
    """The first to end, item or failure; with_item: the first item, all failures together if there is none. The others are stopped."""

    def run():
        if not unis:
            raise NoSuchItem("nothing to join")
        race = _Race(unis)
        try:
            pending, errors = set(race.futures), []
            while pending:
                done, pending = wait(pending, return_when=FIRST_COMPLETED)
                for f in done:
                    if not f.exception():
                        return f.result()
                    if not with_item:
                        raise f.exception()
                    errors.append(f.exception())
            raise CompositeFlowError(errors)
        finally:
            race.stop()

    return Uni(run)


class Subscription:
    """A running pull of a flow's rows."""

    def __init__(self, flow, on_item: Callable, on_failure: Callable | None, on_completion: Callable | None):
        self.spark, self.group, self.cancelled, self.done = flow.df.sparkSession, uuid.uuid4().hex, False, threading.Event()

        def run():
            self.spark.sparkContext.setJobGroup(self.group, "subscription", interruptOnCancel=True)
            try:
                for row in flow:
                    if self.cancelled:
                        return
                    on_item(row)
                if on_completion and not self.cancelled:
                    on_completion()
            except Exception as e:  # noqa: BLE001
                if on_failure and not self.cancelled:
                    on_failure(e)
            finally:
                self.done.set()

        InheritableThread(target=run, daemon=True).start()

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, seconds: float | None = None) -> bool:
        return self.done.wait(seconds)


def hooked(action: Callable[[], Any], on_start: Callable | None = None, on_termination: Callable[[BaseException | None], None] | None = None, on_cancel: Callable | None = None):
    """Runs an action between its lifecycle hooks."""
    if on_start:
        on_start()
    try:
        out = action()
    except BaseException as e:
        if on_cancel and ("cancel" in str(e).lower() or isinstance(e, KeyboardInterrupt)):
            on_cancel()
        if on_termination:
            on_termination(e)
        raise
    if on_termination:
        on_termination(None)
    return out


def broadcast_to(df: DataFrame, *consumers: Callable[[DataFrame], Any], together: bool = False) -> list:
    """One upstream run for several consumers, one after another or together: the data is kept while all of them run."""
    kept = df.persist()
    try:
        if together:
            return join_all([Uni(lambda c=c: c(kept)) for c in consumers]).wait()
        return [c(kept) for c in consumers]
    finally:
        kept.unpersist()
