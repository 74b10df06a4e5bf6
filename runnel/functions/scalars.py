"""Column helpers: tuples, nulls and tolerant forms of failing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tuple_of(*items: Column) -> Column:
    """A product of two to nine items, as fields item1, item2, ..."""
    if not 2 <= len(items) <= 9:
        raise ValueError("a tuple has two to nine items")
    return F.struct(*[c.alias(f"item{i + 1}") for i, c in enumerate(items)])


def map_item(t: Column, n: int, fn) -> Column:
    """The tuple with its nth item (from 1) replaced by fn of it."""
    return t.withField(f"item{n}", fn(t[f"item{n}"]))


def nth(t: Column, n: int) -> Column:
    return t[f"item{n}"]


def as_list(t: Column, size: int) -> Column:
    return F.array(*[t[f"item{i + 1}"] for i in range(size)])


def value_or_error(value: Column, valid: Column, message: str) -> Column:
    """A struct of value and error: failures of single items, to be cut or recovered by order."""
    return F.struct(F.when(valid, value).alias("value"), F.when(~F.coalesce(valid, F.lit(False)), F.lit(message)).alias("error"))


def or_default(value: Column, default) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def or_fail(value: Column, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)).cast("string"))
