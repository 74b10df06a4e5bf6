"""Running and final statistics."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..ordinal import SCANS, moments_scanned, scanned
from ._stream import by_group, key_schema


def exact(value: Column, digits: int = 2) -> Column:
    """A value of so many decimal places as a decimal: sums do not depend on the order of addition."""
    return value.cast(f"decimal(18,{digits})")


def _number(value: str, digits: int | None) -> Column:
    return F.col(value).cast("double") if digits is None else exact(F.col(value), digits)


class Statistics:
    def running_all(self, exclusive: bool = False, **parts: tuple[str, Column]) -> DataFrame:
        """The rows with running aggregates, each a name (sum, count, min, max, last non-null) and a column; exclusive: of the rows before.

        Groups are windows; a flow without keys is scanned range by range (see ordinal.py).
        """
        if not self.by:
            return scanned(self.df, self.order, exclusive, **parts)
        w = self.window().rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        return self.df.withColumns({n: SCANS[how][1](c).over(w) for n, (how, c) in parts.items()})

    def running_count(self, name: str = "count"):
        return self.like(self.running_all(**{name: ("count", F.lit(1))}))

    def running_sum(self, value: str, name: str = "sum", digits: int | None = None):
        """With digits, values are taken as decimals of so many places and summed exactly."""
        out = self.running_all(**{name: ("sum", _number(value, digits))})
        return self.like(out.withColumn(name, F.col(name).cast("double")))

    def running_average(self, value: str, name: str = "average", digits: int | None = None):
        out = self.running_all(__sum=("sum", _number(value, digits)), __count=("count", F.col(value)))
        return self.like(out.withColumn(name, F.col("__sum").cast("double") / F.col("__count")).drop("__sum", "__count"))

    def running_totals(self, value: str, digits: int | None = None):
        """count and sum together."""
        return self.like(self.running_all(count=("count", F.lit(1)), sum=("sum", _number(value, digits))))

    def running_median(self, value: str, name: str = "median") -> DataFrame:
        """Exact, from two heaps: keys, pos, median. Nulls are no items; no items, no median; NaN counts as infinity."""

        def step(state, v):
            low, high = state
            v = float("inf") if v != v else v
            heapq.heappush(low, -heapq.heappushpop(high, v))
            if len(low) > len(high) + 1:
                heapq.heappush(high, -heapq.heappop(low))
            a = -low[0]
            return state, [(len(low) + len(high), a if len(low) > len(high) else a + (high[0] - a) * 0.5)]

        return by_group(self.filter(F.col(value).isNotNull()), lambda: ([], []), step, f"{key_schema(self)}pos long, {name} double", value)

    def _records(self, value: str, better: str):
        now = F.col(value)
        wins = now > F.col("__best") if better == "max" else now < F.col("__best")
        return self.like(self.running_all(exclusive=True, __best=(better, now)).where(now.isNotNull() & (F.col("__best").isNull() | wins)).drop("__best"))

    def max_records(self, value: str):
        """Items that exceed all before them."""
        return self._records(value, "max")

    def min_records(self, value: str):
        return self._records(value, "min")

    def running_top(self, value: str, n: int, kind: str, name: str = "top") -> DataFrame:
        """The n largest distinct values, descending, whenever they change: keys, pos (of items that are not null), top. NaN is left out as null is."""

        def step(state, v):
            at, top = state[0] + 1, state[1]
            if v in top or len(top) == n and v < top[-1]:
                return (at, top), []
            top = sorted([*top, v], reverse=True)[:n]
            return (at, top), [(at, top)]

        item = F.col(value).isNotNull()
        if self.df.schema[value].dataType.typeName() in ("double", "float"):
            item = item & ~F.isnan(value)
        return by_group(self.filter(item), lambda: (0, []), step, f"{key_schema(self)}pos long, {name} array<{kind}>", value)

    def top(self, value: str, n: int) -> DataFrame:
        """The n largest distinct values at the end."""
        if not self.by:
            return self.df.select(value).where(F.col(value).isNotNull()).distinct().orderBy(F.desc(value)).limit(n)
        w = Window.partitionBy(*self.by).orderBy(F.desc(value))
        return self.df.select(*self.by, value).where(F.col(value).isNotNull()).distinct().withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

    @staticmethod
    def _moments(value: str, over=lambda c: c) -> dict[str, Column]:
        v, nan = F.col(value).cast("double"), F.lit(float("nan"))
        return {
            "count": over(F.count(value)), "average": over(F.avg(v)), "variance": F.coalesce(over(F.var_samp(v)), nan), "stddev": F.coalesce(over(F.stddev_samp(v)), nan),
            "skewness": F.coalesce(over(F.skewness(v)), nan), "kurtosis": F.coalesce(over(F.kurtosis(v)), nan), "min": over(F.min(value)), "max": over(F.max(value)),
        }

    def running_statistics(self, value: str, digits: int | None = None):
        """count, average, sample variance and deviation, population skewness and excess kurtosis, min, max; NaN where undefined.

        With digits, values of so many decimal places: average, variance and deviation then come from exact sums. A flow without keys is
        scanned range by range, moments being merged at the ranges' bounds.
        """
        df, v = self.df, F.col(value)
        if self.by:
            df = df.withColumns(self._moments(value, lambda c: c.over(self.running())))
        else:
            m, nan = F.col("__m"), F.lit(float("nan"))
            df = scanned(moments_scanned(df, self.order, value, "__m"), self.order, count=("count", v), min=("min", v), max=("max", v))
            spread = F.when(m["n"] > 1, m["m2"] / (m["n"] - 1)).otherwise(nan)
            varied = m["m2"] > 0
            df = df.withColumns({
                "average": F.when(m["n"] > 0, m["mean"]), "variance": spread, "stddev": F.sqrt(spread),
                "skewness": F.when(varied, F.sqrt(m["n"]) * m["m3"] / F.pow(m["m2"], F.lit(1.5))).otherwise(nan), "kurtosis": F.when(varied, m["n"] * m["m4"] / (m["m2"] * m["m2"]) - 3).otherwise(nan),
            }).drop("__m")
        if digits is not None:
            unit = (exact(v, digits) * 10**digits).cast("decimal(18,0)")
            df = self.like(df).running_all(__s1=("sum", unit), __s2=("sum", (unit * unit).cast("decimal(30,0)")))
            n, s1, s2 = F.col("count"), F.col("__s1"), F.col("__s2")
            spread = (n * s2 - s1 * s1).cast("double") / (n * (n - 1)).cast("double") / float(100**digits)
            df = df.withColumns({"average": s1.cast("double") / n / float(10**digits), "variance": F.when(n > 1, spread).otherwise(float("nan"))})
            df = df.withColumn("stddev", F.sqrt("variance")).drop("__s1", "__s2")
        return self.like(df)

    def statistics(self, value: str) -> DataFrame:
        cols = [c.alias(n) for n, c in self._moments(value).items()]
        return self.df.groupBy(*self.by).agg(*cols) if self.by else self.df.agg(*cols)

    def running_occurrence(self, value: str, name: str = "occurrence"):
        """How often the item's value has come so far."""
        w = Window.partitionBy(*self.by, value).orderBy(*self.asc())
        return self.like(self.df.withColumn(name, F.row_number().over(w).cast("long")))

    def running_histogram(self, value: str, name: str = "histogram") -> DataFrame:
        """Value to how often it has come, after each item: keys, pos, map. A null value counts under no key of the map and repeats the last one."""
        kind = self.df.schema[value].dataType.simpleString()

        def step(state, v):
            at, seen = state
            seen = seen if v is None else seen | {v: seen.get(v, 0) + 1}
            return (at + 1, seen), [(at + 1, sorted(seen.items()))]

        return by_group(self, lambda: (0, {}), step, f"{key_schema(self)}pos long, {name} map<{kind}, long>", value)

    def occurrences(self, value: str) -> DataFrame:
        return self.df.groupBy(*self.by, value).agg(F.count("*").alias("n"))
