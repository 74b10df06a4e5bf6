"""Zip, combine-latest, merge and concatenation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import alike


class Combinations:
    def zip(self, *others, names: list[str] | None = None) -> DataFrame:
        """Items by position, up to the shortest: keys, pos, and a struct item1, item2, ... of each flow's columns but keys and order ranges."""
        flows = [self, *others]
        names = names or [f"item{i + 1}" for i in range(len(flows))]
        out = None
        for f, n in zip(flows, names, strict=True):
            item = F.struct(*[c for c in f.df.columns if c not in f.by]).alias(n)
            at = f.with_pos("__pos")
            if out is None:
                out = at.select(*f.by, F.col("__pos").alias("pos"), item)
                continue
            keys = [f"__k{i}" for i in range(len(self.by))]
            side = at.select(*[F.col(k).alias(t) for k, t in zip(f.by, keys, strict=True)], "__pos", item)
            out = out.join(side, alike([*self.by, "pos"], [*keys, "__pos"])).drop(*keys, "__pos")
        return out

    def latest(self, *others, on: str, names: list[str] | None = None) -> DataFrame:
        """The latest item of each flow at every arrival, once all have one: keys, on, source, item1, item2, ...

        Arrival is defined by the column `on` (every flow has it), then by the flow's place, then by its order.
        """
        flows = [self, *others]
        names = names or [f"item{i + 1}" for i in range(len(flows))]
        tagged = []
        for i, f in enumerate(flows):
            cols = [c for c in f.df.columns if c not in f.by]
            pos = f.with_pos("__pos")
            keys = [F.col(k).alias(t) for k, t in zip(f.by, self.by, strict=True)]
            tagged.append(pos.select(*keys, F.col(on), F.lit(i).alias("source"), "__pos", F.struct(*cols).alias(names[i])))
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
        filled = self.like(every, order=[on, "source", "__pos"]).running_all(**{n: ("last", F.col(n)) for n in names})
        return filled.where(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])).drop("__pos")

    def collect_failures(self, *others, error: str, combine: str = "concat", **how):
        """Combines what each flow has before its first failed item, whose `error` column holds a message, and tells all failures afterwards.

        Returns the combination (concat, zip, latest or merge) and the failures: keys, source, error. fail_with_all() makes one failure of them.
        """
        flows = [self, *others]
        kept = [f.take_while(F.col(error).isNull()) for f in flows]
        keyed = [f.failures(error).select(*[F.col(k).alias(t) for k, t in zip(f.by, self.by, strict=True)], F.lit(i).alias("source"), "error") for i, f in enumerate(flows)]
        return getattr(kept[0], combine)(*kept[1:], **how), reduce(lambda a, b: a.unionByName(b), keyed)

    def merge(self, *others):
        """All items; order as the flows' own."""
        return self.like(reduce(lambda a, b: a.unionByName(b), [self.df, *[o.df for o in others]]))

    def concat(self, *others, source: str = "source"):
        """All items of the first flow, then of the next; the order begins with the flow's number."""
        if not others:
            return self
        frames = [f.df.withColumn(source, F.lit(i)) for i, f in enumerate([self, *others])]
        return self.like(reduce(lambda a, b: a.unionByName(b), frames), order=[source, *self.order])




def fail_with_all(combined: DataFrame, failures: DataFrame) -> DataFrame:
    """The combination, whose action fails at its end if there are failures: by the one, or by all together."""
    first, kinds = combined.columns[0], combined.schema
    errors = failures.agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "error"))), lambda e: e["error"]).alias("__e")).where(F.size("__e") > 0)
    message = F.when(F.size("__e") == 1, F.col("__e")[0]).otherwise(F.concat(F.lit("multiple failures: "), F.array_join("__e", "; ")))
    failing = errors.select(*[(F.raise_error(message) if c == first else F.lit(None)).cast(kinds[c].dataType).alias(c) for c in combined.columns])
    return combined.unionByName(failing)
