"""Prefixes, suffixes, runs, distinct items."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def _checked(n: int) -> int:
    if n < 0:
        raise ValueError("a count must not be negative")
    return n


class Selections:
    def first(self, n: int = 1):
        """The first n items (of each group)."""
        if not _checked(n):
            return self.ignore()
        if not self.by:
            return self.like(self.df.orderBy(*self.asc()).limit(n))
        return self.like(self.df.withColumn("__n", F.row_number().over(self.window())).where(F.col("__n") <= n).drop("__n"))

    def last(self, n: int = 1):
        """The last n items (of each group)."""
        if not _checked(n):
            return self.ignore()
        if not self.by:
            return self.like(self.df.orderBy(*self.desc()).limit(n))
        w = Window.partitionBy(*self.by).orderBy(*self.desc())
        return self.like(self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n"))

    def skip_first(self, n: int = 1):
        if not _checked(n):
            return self
        return self.like(self.with_pos("__n").where(F.col("__n") > n).drop("__n"))

    def skip_last(self, n: int = 1):
        if not _checked(n):
            return self
        if self.by:
            w = Window.partitionBy(*self.by).orderBy(*self.desc())
            return self.like(self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > n).drop("__n"))
        total = self.df.agg(F.count("*").alias("__total"))
        return self.like(self.with_pos("__n").crossJoin(F.broadcast(total)).where(F.col("__n") <= F.col("__total") - n).drop("__n", "__total"))

    def _cut(self, predicate: Column):
        """The order of the first item of each group for which the predicate is not true, as one row a group."""
        bad = self.df.where(~F.coalesce(predicate, F.lit(False)))
        cut = F.min(F.struct(*self.order)).alias("__cut")
        return bad.groupBy(*self.by).agg(cut) if self.by else bad.agg(cut)

    def _with_cut(self, predicate: Column):
        cut = self._cut(predicate)
        if not self.by:
            return self.df.crossJoin(F.broadcast(cut))
        keys = cut.select(*[F.col(k).alias(f"__{k}") for k in self.by], "__cut")
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.by]
        return self.df.join(keys, on, "left").drop(*[f"__{k}" for k in self.by])

    def take_while(self, predicate: Column):
        """Items before the first that fails the predicate."""
        return self.like(self._with_cut(predicate).where(F.col("__cut").isNull() | (F.struct(*self.order) < F.col("__cut"))).drop("__cut"))

    def drop_while(self, predicate: Column):
        """Items from the first on that fails the predicate."""
        return self.like(self._with_cut(predicate).where(F.struct(*self.order) >= F.col("__cut")).drop("__cut"))

    def _since_start(self) -> Column:
        if not self.ts:
            raise ValueError("the flow has no time column")
        return F.min(self.ts).over(Window.partitionBy(*self.by)) if self.by else None

    def _timed(self, keep):
        if self.by:
            return self.like(self.df.withColumn("__t0", self._since_start()).where(keep(F.col("__t0"))).drop("__t0"))
        start = self.df.agg(F.min(self.ts).alias("__t0"))
        return self.like(self.df.crossJoin(F.broadcast(start)).where(keep(F.col("__t0"))).drop("__t0"))

    def first_for(self, duration: str):
        """Items of the first so long in event time, such as '2 days'."""
        self._since_start()
        return self._timed(lambda t0: F.col(self.ts) < t0 + F.expr(f"INTERVAL {duration}"))

    def skip_for(self, duration: str):
        self._since_start()
        return self._timed(lambda t0: F.col(self.ts) >= t0 + F.expr(f"INTERVAL {duration}"))

    def distinct(self, *keys: str | Column):
        """The first item of each key. A comparator that calls items equal is given as a canonical key, such as lower(x)."""
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        w = Window.partitionBy(*self.by, *cols).orderBy(*self.asc())
        return self.like(self.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"))

    def skip_repetitions(self, *keys: str | Column):
        """Items unlike the one before."""
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        item = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
        df = self.like(self.df.withColumn("__item", item)).running_all(exclusive=True, __before=("last", F.col("__item")))
        return self.like(df.where(F.col("__before").isNull() | ~F.col("__item").eqNullSafe(F.col("__before"))).drop("__item", "__before"))
