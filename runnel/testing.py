"""Helpers for tests of flows: assertions on items and failures, and a count of what passes."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import functions as F

from .flow import Flow


def assert_items(flow: Flow, expected: Iterable, column: str = "item") -> Flow:
    """The flow completes, and its items are these, in order."""
    got, expected = flow.to_list(column).wait(), list(expected)
    assert got == expected, f"got {got}, expected {expected}"
    return flow


def assert_completed(flow: Flow, count: int | None = None) -> Flow:
    """The flow completes, with so many items."""
    n = flow.df.count()
    assert count is None or n == count, f"{n} items, not {count}"
    return flow


def assert_failed(flow: Flow, match: str = "") -> str:
    """The flow fails, with a message that matches; returns it."""
    try:
        flow.df.collect()
    except Exception as e:  # noqa: BLE001
        assert re.search(match, str(e)), f"failed otherwise: {e}"
        return str(e)
    raise AssertionError("the flow completed")


class Spy:
    """Counts items, and non-null values, of a flow's next action; the items pass unchanged."""

    def __init__(self, name: str = "spy"):
        from pyspark.sql import Observation

        self._seen = Observation(name)

    def on(self, flow: Flow, *columns: str) -> Flow:
        return flow.observe(self._seen, items=F.count(F.lit(1)), **{f"n_{c}": F.count(c) for c in columns})

    @property
    def counts(self) -> dict:
        return self._seen.get
