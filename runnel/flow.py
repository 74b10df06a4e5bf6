"""Flow: a DataFrame with a declared total order, optional grouping keys and an optional event-time column.

Every operator derives its schema without a job and returns a new Flow; nothing is computed before an action, but for the
boundaries of order ranges. Positional operators number the items of each group; a flow without keys is numbered and scanned
through order ranges (see ordinal.py), whose boundaries are sampled when the operator is applied, so that no window holds the
whole table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .operators import aggregate, combine, failure, fold, select, stats, transform, windows
from .ordinal import numbered
from .policies import Subscription, Uni


_INTERCEPTORS: list[Callable] = []
_INSIDE = threading.local()


def intercept(fn: Callable[[Flow], Flow]) -> Callable[[], None]:
    """Lets fn see, and replace, the flow that each operator gives; the function returned takes it out again."""
    _INTERCEPTORS.append(fn)
    return lambda: _INTERCEPTORS.remove(fn)


class Flow(transform.Transforms, select.Selections, windows.Windows, fold.Folds, stats.Statistics, aggregate.Aggregations, combine.Combinations, failure.Failures):
    def __init__(self, df: DataFrame, order: Sequence[str] | str, by: Sequence[str] | str = (), ts: str | None = None):
        self.df = df
        self.order = [order] if isinstance(order, str) else list(order)
        self.by = [by] if isinstance(by, str) else list(by)
        self.ts = ts
        self._ends: list[Callable] = []
        missing = [c for c in [*self.order, *self.by, *([ts] if ts else [])] if c not in df.columns]
        if not self.order or missing:
            raise ValueError(f"a flow needs order columns of its DataFrame; missing: {missing}")

    # -- plumbing for operators

    def like(self, df: DataFrame, order: Sequence[str] | None = None, by: Sequence[str] | None = None) -> Flow:
        ts = self.ts if self.ts in df.columns else None
        out = Flow(df, self.order if order is None else order, self.by if by is None else by, ts)
        out._ends = self._ends
        if _INTERCEPTORS and not getattr(_INSIDE, "on", False):
            _INSIDE.on = True  # what an interceptor itself builds is not intercepted
            try:
                for fn in list(_INTERCEPTORS):
                    out = fn(out)
            finally:
                _INSIDE.on = False
        return out

    def asc(self) -> list[Column]:
        return [F.asc_nulls_first(c) for c in self.order]

    def desc(self) -> list[Column]:
        return [F.desc_nulls_last(c) for c in self.order]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.asc())

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def with_pos(self, name: str = "pos") -> DataFrame:
        """The rows with their position in the group, from 1."""
        if self.by:
            return self.df.withColumn(name, F.row_number().over(self.window()).cast("long"))
        return numbered(self.df, self.order, name)

    # -- composition

    def pipe(self, fn: Callable[[Flow], Flow], *args, **kwargs) -> Flow:
        """Applies a whole-pipeline function: the way to plug in operators of one's own."""
        return fn(self, *args, **kwargs)

    def group_by(self, *keys: str) -> Flow:
        """The items as keyed sub-streams; a null key is a group."""
        return Flow(self.df, self.order, keys, self.ts)

    def ungrouped(self) -> Flow:
        return Flow(self.df, [*self.order, *[k for k in self.by if k not in self.order]], (), self.ts)

    # -- terminals

    def subscribe(self, on_item: Callable, on_failure: Callable | None = None, on_completion: Callable | None = None) -> Subscription:
        """Calls on_item for each row in order, in a thread of its own; the subscription can be cancelled and awaited."""
        return Subscription(self, on_item, on_failure, on_completion)

    def to_uni(self) -> Uni:
        """The first row, or None."""
        return Uni.first_of(self.first(1).df)

    def to_list(self, column: str | None = None) -> Uni:
        """All rows, or one column's values, in order."""
        return Uni(lambda: [r if column is None else r[column] for r in self])

    def cache(self) -> Cached:
        """The flow with its items kept after the first use, for all later ones, until released."""
        return Cached(self.df.persist(), self.order, self.by, self.ts)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def on_termination(self, fn: Callable[[BaseException | None, bool], None]) -> Flow:
        """A flow that, when its rows are pulled, calls fn(failure, cancelled) at their end: by completion, by failure, or because no more are asked for."""
        out = Flow(self.df, self.order, self.by, self.ts)
        out._ends = [*self._ends, fn]
        return out

    def __iter__(self) -> Iterable:
        """Blocking pull of rows in order, a partition at a time."""
        rows = self.df.orderBy(*self.by, *self.asc()).toLocalIterator()
        return self._pulled(rows) if self._ends else rows

    def _pulled(self, rows: Iterable) -> Iterable:
        end: tuple = (None, True)
        try:
            yield from rows
            end = (None, False)
        except Exception as e:
            end = (e, False)
            raise
        finally:
            for fn in self._ends:
                fn(*end)


class Cached(Flow):
    """A flow whose items are kept; what is derived from it reads them. Released at the end of a with block, or by release()."""

    def release(self) -> None:
        self.df.unpersist()

    def __enter__(self) -> Cached:
        return self

    def __exit__(self, *failure) -> None:
        self.release()
