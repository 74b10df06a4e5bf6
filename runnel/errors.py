"""Exceptions of the engine."""

from __future__ import annotations


class FlowError(Exception):
    """A failure of a flow."""


class NoSuchItem(FlowError):
    """An empty flow where an item was asked for."""


class FlowTimeout(FlowError):
    """No result, or no item, in time."""


class Overflow(FlowError):
    """More items than a buffer holds."""


class CompositeFlowError(FlowError):
    """Several failures at once; the first is the cause."""

    def __init__(self, causes: list[BaseException]):
        super().__init__("multiple failures: " + "; ".join(str(c) for c in causes))
        self.causes = causes
        self.__cause__ = causes[0] if causes else None
