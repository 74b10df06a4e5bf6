"""Collectors: one result a flow, or a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import listed


class Aggregations:
    def _agg(self, *cols: Column) -> DataFrame:
        return self.df.groupBy(*self.by).agg(*cols) if self.by else self.df.agg(*cols)

    def collect_first(self, value: str, name: str = "first") -> DataFrame:
        """The first item, or null."""
        return self._agg(F.min_by(value, F.struct(*self.order)).alias(name))

    def collect_last(self, value: str, name: str = "last") -> DataFrame:
        return self._agg(F.max_by(value, F.struct(*self.order)).alias(name))

    def collect_list(self, value: str | Column, name: str = "items") -> DataFrame:
        return self._agg(listed(F.col(value) if isinstance(value, str) else value, self.order).alias(name))

    def collect_set(self, value: str, name: str = "items") -> DataFrame:
        """The distinct items, sorted."""
        return self._agg(F.array_sort(F.collect_set(value)).alias(name))

    def collect_map(self, key: str, value: str, name: str = "map", merge: Column | None = None) -> DataFrame:
        """Key to value; a key that comes twice fails, unless merge (an aggregate of the values) says what becomes of them."""
        if merge is None:
            return self._agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
        merged = self.df.groupBy(*self.by, key).agg(merge.alias("__v"))
        entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col("__v"))))).alias(name)
        return merged.groupBy(*self.by).agg(entries) if self.by else merged.agg(entries)

    def collect_multimap(self, key: str, value: str, name: str = "map") -> DataFrame:
        """Key to its ordered values."""
        return self.collect_map(key, value, name, merge=listed(F.col(value), self.order))

    def collect_with(self, **aggregates: Column) -> DataFrame:
        """Any aggregate functions."""
        return self._agg(*[c.alias(n) for n, c in aggregates.items()])

    def collect_in(self, value: str, seed: Column, merge: Callable, name: str = "fold") -> DataFrame:
        return self.fold(value, seed, merge, name)

    def groups(self) -> DataFrame:
        """The keys in first-seen order: keys, n, and the order of the first item."""
        if not self.by:
            raise ValueError("the flow has no keys")
        return self.df.groupBy(*self.by).agg(F.count("*").alias("n"), F.min(F.struct(*self.order)).alias("first_seen"))
