"""Global positions and running aggregates without a window over the whole table.

Rows are dealt into ranges of the first order column by sampled splitters; each range is scanned by itself, and the ranges'
totals, a row a range, are scanned in turn and broadcast. Rows that tie on the first order column share a range, and
ranges that hold far more rows than others show that it has heavy ties: put a finer column first then.

The number of ranges follows the number of rows. Counting them and drawing the sample are two jobs that run when the operator
is applied, the only ones that do: a count reads no column of a columnar table, the sample only the first order column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

#: Rows in a range, about; and ranges at least and at most. Their totals and sampled keys are what the driver holds.
ROWS = 1 << 20
LEAST, MOST = 64, 1 << 16
#: Sampled keys a range.
KEYS = 16


def _leading(df: DataFrame, column: str) -> tuple[Column, DataType]:
    """The column, or the first field of a struct column: what decides the order first."""
    kind, c = df.schema[column].dataType, F.col(column)
    while isinstance(kind, StructType):
        c, kind = c[kind[0].name], kind[0].dataType
    return c, kind


def splitters(df: DataFrame, column: str, ranges: int | None = None) -> list:
    """Boundaries of the column from a bounded sample."""
    rows = df.count()
    ranges = ranges or min(MOST, max(LEAST, rows // ROWS))
    size = KEYS * ranges
    c, _ = _leading(df, column)
    values = df.select(c.alias("v")).where("v IS NOT NULL")
    if rows > size:
        values = values.sample(min(1.0, size / rows), seed=11)
    drawn = sorted(r[0] for r in values.limit(2 * size).collect())
    return sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []


def in_range(df: DataFrame, column: str, bounds: list) -> Column:
    """The index of the range: how many boundaries are at or below the value; nulls come first."""
    if not bounds:
        return F.lit(0)
    value, of = _leading(df, column)
    table, kind = F.array(*[F.lit(b).cast(of) for b in bounds]), F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    n = len(bounds)
    search = F.aggregate(kind, F.lit(0), lambda lo, s: F.when((lo + s <= n) & (F.get(table, lo + s - 1) <= value), lo + s).otherwise(lo))
    return F.when(value.isNull(), F.lit(0)).otherwise(search)


def dealt(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.withColumn("__range", in_range(df, order[0], splitters(df, order[0])))


def _in_order(order: Sequence[str], upto: int = 0):
    return Window.partitionBy("__range").orderBy(*[F.asc_nulls_first(c) for c in order]).rowsBetween(Window.unboundedPreceding, upto)


def _before():
    """Of the ranges before this one: a row a range."""
    return Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """df with the 1-based position of each row in the order."""
    rows = dealt(df, order)
    starts = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(_before()), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__range").withColumn(name, (F.row_number().over(_in_order(order)) + F.col("__start")).cast("long")).drop("__range", "__start")


def _added(a: Column, b: Column) -> Column:
    return F.coalesce(a + b, a, b)


#: By name: the aggregate over a range's rows (in an order), the running one, and how a range's carry and a running value combine.
SCANS = {
    "sum": (lambda c, o: F.sum(c), lambda c: F.sum(c), _added),
    "count": (lambda c, o: F.count(c), lambda c: F.count(c), _added),
    "min": (lambda c, o: F.min(c), lambda c: F.min(c), F.least),
    "max": (lambda c, o: F.max(c), lambda c: F.max(c), F.greatest),
    "last": (lambda c, o: F.max_by(c, F.when(c.isNotNull(), o)), lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(b, a)),
}


def scanned(df: DataFrame, order: Sequence[str], exclusive: bool = False, **parts: tuple[str, Column]) -> DataFrame:
    """df with running aggregates (name of the aggregate in SCANS, column) over the whole order, range by range; exclusive: of the rows before."""
    rows, o = dealt(df, order), F.struct(*order)
    totals = rows.groupBy("__range").agg(*[SCANS[how][0](c, o).alias(f"__{n}") for n, (how, c) in parts.items()])
    again = {n: F.sum(f"__{n}") if how == "count" else SCANS[how][1](F.col(f"__{n}")) for n, (how, _) in parts.items()}
    starts = totals.select("__range", *[c.over(_before()).alias(f"__{n}") for n, c in again.items()])
    w = _in_order(order, -1 if exclusive else 0)
    out = rows.join(F.broadcast(starts), "__range")
    out = out.withColumns({f"__in_{n}": SCANS[how][1](c).over(w) for n, (how, c) in parts.items()})
    out = out.withColumns({n: SCANS[how][2](F.col(f"__{n}"), F.col(f"__in_{n}")) for n, (how, _) in parts.items()})
    return out.drop("__range", *[f"__{n}" for n in parts], *[f"__in_{n}" for n in parts])


# -- moments: count, mean and sums of powers of deviations, which merge


def moments(value: Column, over=lambda c: c) -> Column:
    """A struct n, mean, m2, m3, m4 of the values."""
    v = value.cast("double")
    n, spread = over(F.count(v)), over(F.var_pop(v))
    m2 = F.coalesce(spread * n, F.lit(0.0))
    varied = m2 > 0
    skew, kurt = over(F.skewness(v)), over(F.kurtosis(v))
    return F.struct(
        n.cast("double").alias("n"), F.coalesce(over(F.avg(v)), F.lit(0.0)).alias("mean"), m2.alias("m2"),
        F.when(varied, skew * F.pow(m2, F.lit(1.5)) / F.sqrt(n)).otherwise(0.0).alias("m3"), F.when(varied, (kurt + 3) * m2 * m2 / n).otherwise(0.0).alias("m4"),
    )


def merged(a: Column, b: Column) -> Column:
    """The moments of two sets of values together."""
    na, nb, n, d = a["n"], b["n"], a["n"] + b["n"], b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + d * nb / n).alias("mean"), (a["m2"] + b["m2"] + d * d * na * nb / n).alias("m2"),
        (a["m3"] + b["m3"] + d * d * d * na * nb * (na - nb) / (n * n) + 3.0 * d * (na * b["m2"] - nb * a["m2"]) / n).alias("m3"),
        (a["m4"] + b["m4"] + d * d * d * d * na * nb * (na * na - na * nb + nb * nb) / (n * n * n) + 6.0 * d * d * (na * na * b["m2"] + nb * nb * a["m2"]) / (n * n)
         + 4.0 * d * (na * b["m3"] - nb * a["m3"]) / n).alias("m4"),
    )
    return F.when(na == 0, b).when(nb == 0, a).otherwise(both)


def moments_scanned(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """df with the running moments of a column over the whole order, range by range."""
    rows = dealt(df, order)
    none = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "mean", "m2", "m3", "m4")])
    totals = rows.groupBy("__range").agg(moments(F.col(value)).alias("__m"))
    starts = totals.select("__range", F.aggregate(F.collect_list("__m").over(_before()), none, merged).alias("__before"))
    w = _in_order(order)
    out = rows.join(F.broadcast(starts), "__range").withColumn("__own", moments(F.col(value), lambda c: c.over(w)))
    return out.withColumn(name, merged(F.col("__before"), F.col("__own"))).drop("__range", "__before", "__own")
