"""How queries are registered, and the flows that they begin with."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..flow import Flow
from ..sources import create

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB SQL that gives the same rows."""

    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def events(spark: SparkSession, sf_dir: str, by=("user_id",)) -> Flow:
    return create.table(spark, f"{sf_dir}/events.parquet", ["ts", "event_id"], by, "ts")


def orders(spark: SparkSession, sf_dir: str, by=("o_custkey",)) -> Flow:
    return create.table(spark, f"{sf_dir}/orders.parquet", ["o_orderdate", "o_orderkey"], by, "o_orderdate")


def text(items):
    """An array as one string: both engines print it alike."""
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


W = "(PARTITION BY user_id ORDER BY ts, event_id)"
RUN = "(PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
POS = f"SELECT *, row_number() OVER {W} AS pos FROM events"
GPOS = "SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events"

#: Buffers one item after another: the anchor, what is held, and the buffer's number. {key}, {items} and {limit} are filled in.
ANCHORED = """
WITH RECURSIVE p AS (SELECT {key} AS k, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS pos FROM events),
b AS (SELECT k, pos, event_id, t AS anchor, 1 AS held, 0::BIGINT AS buffer_id FROM p WHERE pos = 1
  UNION ALL
  SELECT p.k, p.pos, p.event_id, CASE WHEN p.t >= anchor + 86400000000 OR held >= {limit} THEN p.t ELSE anchor END, CASE WHEN p.t >= anchor + 86400000000 OR held >= {limit} THEN 1 ELSE held + 1 END,
    CASE WHEN p.t >= anchor + 86400000000 OR held >= {limit} THEN buffer_id + 1 ELSE buffer_id END
  FROM b JOIN p ON p.k IS NOT DISTINCT FROM b.k AND p.pos = b.pos + 1)
SELECT k AS {name}, buffer_id, count(*) AS n, min(event_id) AS least FROM b GROUP BY ALL"""
