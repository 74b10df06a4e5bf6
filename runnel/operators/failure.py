"""Empty flows, completion, failures of items and gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import alike


class Failures:
    def if_empty(self, other):
        """The other flow if this one has no item; decided when it runs."""
        some = self.df.limit(1).select(F.lit(1).alias("__one"))
        fallback = other.df.withColumn("__one", F.lit(1)).join(F.broadcast(some), "__one", "left_anti").drop("__one")
        return self.like(self.df.unionByName(fallback.select(*self.df.columns)))

    def if_empty_fail(self, message: str = "no such item"):
        """Fails at the action if there is no item."""
        first = self.df.columns[0]
        kind = self.df.schema[first].dataType
        empty = self.df.agg(F.count("*").alias("__n")).where("__n = 0")
        failing = empty.select(*[F.raise_error(F.lit(message)).cast(kind).alias(first) if c == first else F.lit(None).cast(self.df.schema[c].dataType).alias(c) for c in self.df.columns])
        return self.like(self.df.unionByName(failing))

    def then(self, other):
        """The other flow after this one's completion."""
        return self.concat(other)

    def recover_with_completion(self, failed: Column):
        """Items before the first failed one (of each group)."""
        return self.take_while(~F.coalesce(failed, F.lit(False)))

    def recover_with(self, failed: Column, other):
        """Items before the first failed one, then the other flow's, if any failed; in a flow with keys group by group."""
        kept = self.recover_with_completion(failed)
        bad = self.df.where(F.coalesce(failed, F.lit(False)))
        if self.by:
            groups = bad.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.by)]).distinct()
            fallback = other.df.join(groups, alike(self.by, groups.columns), "left_semi")
        else:
            some = bad.limit(1).select(F.lit(1).alias("__one"))
            fallback = other.df.withColumn("__one", F.lit(1)).join(F.broadcast(some), "__one", "left_semi").drop("__one")
        return kept.concat(other.like(fallback.select(*self.df.columns)))

    def recover_with_item(self, failed: Column, **values: Column):
        """Items before the first failed one, then in its place an item with the given columns (others as in the failed item)."""
        bad = self.df.where(F.coalesce(failed, F.lit(False)))
        row = F.min_by(F.struct(*self.df.columns), F.struct(*self.order)).alias("__r")
        first = (bad.groupBy(*self.by).agg(row) if self.by else bad.agg(row).where(F.col("__r").isNotNull())).select("__r.*").withColumns(values)
        kept = self.recover_with_completion(failed)
        return self.like(kept.df.unionByName(first.select(*self.df.columns)))

    def transform_failure(self, failed: Column, message: Column):
        """A failed item fails the action with this message instead."""
        first = self.df.columns[0]
        return self.like(self.df.withColumn(first, F.when(F.coalesce(failed, F.lit(False)), F.raise_error(message).cast(self.df.schema[first].dataType)).otherwise(F.col(first))))

    def failures(self, error: str) -> DataFrame:
        """The first failed item of each group, where `error` holds a message: keys, error."""
        bad = self.df.where(F.col(error).isNotNull())
        first = F.min_by(error, F.struct(*self.order)).alias("error")
        return bad.groupBy(*self.by).agg(first) if self.by else bad.agg(first).where("error IS NOT NULL")

    def with_gaps(self, seconds: float, name: str = "gap"):
        """The items with whether none came for longer than so many seconds before this one. Items without a time have and make no gap."""
        t = F.unix_micros(F.col(self.ts).cast("timestamp"))
        before = self.running_all(exclusive=True, __before=("last", t))
        return self.like(before.withColumn(name, F.coalesce(t - F.col("__before") > int(seconds * 1_000_000), F.lit(False))).drop("__before"))

    def until_inactive(self, seconds: float):
        """Items up to the first gap longer than `seconds`; the rest has timed out."""
        return self.like(self.with_gaps(seconds, "__gap").take_while(~F.col("__gap")).df.drop("__gap"))
