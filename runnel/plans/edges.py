"""Queries over null keys and values, over flows without keys, and of operators on sub-flows, demand and failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..flow import Flow
from ..operators.combine import fail_with_all
from ..operators.fold import Gatherer
from ..operators.stats import exact
from ..sources import create
from .register import ANCHORED, GPOS, POS, W, events, query, text

#: Events by a key that is null for every seventh user, with a value that is null in every fifth event.
NULLS = "(SELECT *, nullif(user_id % 7, 0) AS k, CASE WHEN event_id % 5 <> 0 THEN value END AS v FROM events)"
NW = "(PARTITION BY k ORDER BY ts, event_id)"
NRUN = "(PARTITION BY k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
NPOS = f"SELECT *, row_number() OVER {NW} AS pos FROM {NULLS}"


def _nulls(spark, sf_dir) -> Flow:
    df = events(spark, sf_dir).df.withColumns({"k": F.nullif(F.col("user_id") % 7, F.lit(0)), "v": F.when(F.col("event_id") % 5 != 0, F.col("value"))})
    return Flow(df, ["ts", "event_id"], "k", "ts")


@query(f"SELECT k, pos, quantile_cont(v, 0.5) OVER (PARTITION BY k ORDER BY pos ROWS UNBOUNDED PRECEDING) AS median FROM (SELECT *, row_number() OVER {NW} AS pos FROM {NULLS} WHERE v IS NOT NULL)")
def null_keys_running_median(spark, sf_dir):
    return _nulls(spark, sf_dir).running_median("v")


@query(f"""
WITH t AS (SELECT k, row_number() OVER {NW} AS pos, array_to_string(list_slice(list_reverse_sort(list_distinct(list((v * 100)::BIGINT) OVER {NRUN})), 1, 3), ',') AS top FROM {NULLS} WHERE v IS NOT NULL),
l AS (SELECT *, lag(top) OVER (PARTITION BY k ORDER BY pos) AS before FROM t)
SELECT k, pos, top FROM l WHERE before IS DISTINCT FROM top""")
def null_keys_running_top3(spark, sf_dir):
    flow = _nulls(spark, sf_dir).map(on_null="keep", cents=(exact(F.col("v")) * 100).cast("long"))
    return flow.running_top("cents", 3, "long").withColumn("top", text("top"))


@query(f"SELECT k, pos, max(event_id) OVER {NRUN} AS scan FROM ({NPOS})")
def null_keys_scan(spark, sf_dir):
    return _nulls(spark, sf_dir).scan("event_id", lambda a, b: max(a, b), "long")


@query(f"SELECT k, ((pos - 1) // 7 + 1)::BIGINT AS seq, sum(event_id)::BIGINT AS item FROM ({NPOS}) GROUP BY ALL")
def null_keys_gather(spark, sf_dir):
    g = Gatherer(lambda: [], lambda s, v: [*s, v], lambda s, done: (s[7:], sum(s[:7])) if len(s) >= 7 or done and s else None)
    return _nulls(spark, sf_dir).gather("event_id", g, "long")


_SIDE = f"SELECT k, event_id, row_number() OVER {NW} AS pos FROM {NULLS} WHERE event_type = '{{}}'"


@query(f"SELECT a.k, a.pos, a.event_id AS id1, b.event_id AS id2 FROM ({_SIDE.format('click')}) a JOIN ({_SIDE.format('purchase')}) b ON a.k IS NOT DISTINCT FROM b.k AND a.pos = b.pos")
def null_keys_zip(spark, sf_dir):
    side = lambda kind: _nulls(spark, sf_dir).filter(F.col("event_type") == kind).only()
    return side("click").zip(side("purchase")).select("k", "pos", F.col("item1.event_id").alias("id1"), F.col("item2.event_id").alias("id2"))


@query(f"""
WITH p AS ({NPOS}), c AS (SELECT k, count(*) AS n FROM p GROUP BY 1),
w AS (SELECT p.k, slot, event_id, pos, n FROM (SELECT *, unnest(range(greatest(0, pos - 4), pos)) AS slot FROM p) p JOIN c ON p.k IS NOT DISTINCT FROM c.k)
SELECT k, slot AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM w WHERE slot <= greatest(0, n - 4 + 1) AND (n >= 4 OR slot = 0) GROUP BY ALL""")
def null_keys_sliding(spark, sf_dir):
    return _nulls(spark, sf_dir).sliding("event_id", 4).withColumn("items", text("items"))


@query("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos, count(*) OVER () AS n FROM events),
w AS (SELECT *, unnest(range(greatest(0, pos - 5), pos)) AS slot FROM p)
SELECT slot AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM w WHERE slot <= greatest(0, n - 5 + 1) AND (n >= 5 OR slot = 0) GROUP BY ALL""")
def sliding_window_global(spark, sf_dir):
    return events(spark, sf_dir, ()).sliding("event_id", 5).withColumn("items", text("items"))


@query(f"""
WITH e AS {NULLS}, b AS (SELECT k, min(ts) AS t0, max(ts) AS t1 FROM e GROUP BY 1),
w AS (SELECT k, t0, unnest(range(0, (epoch_us(t1) - epoch_us(t0)) // 3600000000 + 1)) AS slot FROM b),
c AS (SELECT e.k, (epoch_us(ts) - epoch_us(t0)) // 3600000000 AS slot, count(*) AS n FROM e JOIN b ON e.k IS NOT DISTINCT FROM b.k GROUP BY ALL)
SELECT w.k, epoch_us(t0) + w.slot * 3600000000 AS start_us, coalesce(n, 0) AS n FROM w LEFT JOIN c ON w.k IS NOT DISTINCT FROM c.k AND w.slot = c.slot""")
def null_keys_time_windows(spark, sf_dir):
    return _nulls(spark, sf_dir).time_windows("1 hour").select("k", F.unix_micros("window_start").alias("start_us"), "n")


@query("SELECT epoch_us(TIMESTAMP '2024-01-02') + slot * 3600000000 AS start_us, count(event_id) AS n FROM (SELECT unnest(range(0, (SELECT max(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) // 3600000000 + 1 FROM events))) AS slot) LEFT JOIN events ON ts >= TIMESTAMP '2024-01-02' AND (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) // 3600000000 = slot GROUP BY slot")
def time_windows_global(spark, sf_dir):
    return events(spark, sf_dir, ()).time_windows("1 hour", start="2024-01-02").select(F.unix_micros("window_start").alias("start_us"), "n")


@query(ANCHORED.format(key="nullif(user_id % 41, 0)", name="k", limit=5))
def null_keys_buffer_for(spark, sf_dir):
    df = events(spark, sf_dir).df.withColumn("k", F.nullif(F.col("user_id") % 41, F.lit(0)))
    return Flow(df, ["ts", "event_id"], "k", "ts").buffer_for(86400.0, 5).groupBy("k", "buffer_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


# -- flows without keys, range by range

G = "(ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
GPAST = "(ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT event_id, sum(value::DECIMAL(18,2)) OVER {G}::DOUBLE / count(value) OVER {G} AS average, count(*) OVER {G} AS count FROM events")
def running_average_global(spark, sf_dir):
    return events(spark, sf_dir, ()).running_average("value", digits=2).running_count().df.select("event_id", "average", "count")


@query(f"SELECT event_id, value FROM (SELECT *, max(value) OVER {GPAST} AS b FROM events) WHERE b IS NULL OR value > b")
def max_records_global(spark, sf_dir):
    return events(spark, sf_dir, ()).max_records("value").df.select("event_id", "value")


@query(f"SELECT event_id, value FROM (SELECT *, min(value) OVER {GPAST} AS b FROM events) WHERE b IS NULL OR value < b")
def min_records_global(spark, sf_dir):
    return events(spark, sf_dir, ()).min_records("value").df.select("event_id", "value")


@query(f"SELECT event_id, max(event_id) OVER {G} AS most, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER {G} AS click FROM events")
def scan_global(spark, sf_dir):
    flow = events(spark, sf_dir, ()).scan_with("event_id", "max", "most")
    return flow.scan_with(F.when(F.col("event_type") == "click", F.col("event_id")), "last", "click").df.select("event_id", "most", "click")


@query(f"SELECT pos, (1000 + sum(event_id) OVER {G})::BIGINT AS scan FROM ({GPOS}) UNION ALL SELECT 0, 1000")
def scan_seed_global(spark, sf_dir):
    return events(spark, sf_dir, ()).scan_seeded("event_id", 1000, "sum")


@query(f"SELECT user_id, pos, greatest(500, max(event_id) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS scan FROM ({POS}) UNION ALL SELECT DISTINCT user_id, 0, 500 FROM events")
def scan_seed_named(spark, sf_dir):
    return events(spark, sf_dir).scan_seeded("event_id", 500, "max")


@query("SELECT sum(event_id)::BIGINT AS fold FROM events")
def fold_global(spark, sf_dir):
    return events(spark, sf_dir, ()).fold("event_id", F.lit(0).cast("long"), lambda a, x: a + x, combine=lambda a, b: a + b)


@query("""
WITH u AS (SELECT ts, 0 AS source, event_id, event_id AS a, NULL AS b FROM events WHERE event_type = 'click' UNION ALL SELECT ts, 1, event_id, NULL, event_id FROM events WHERE event_type = 'purchase'),
f AS (SELECT source, last_value(a IGNORE NULLS) OVER w AS id1, last_value(b IGNORE NULLS) OVER w AS id2 FROM u WINDOW w AS (ORDER BY ts, source, event_id ROWS UNBOUNDED PRECEDING))
SELECT source, id1, id2 FROM f WHERE id1 IS NOT NULL AND id2 IS NOT NULL""")
def combine_latest_global(spark, sf_dir):
    side = lambda kind: events(spark, sf_dir, ()).filter(F.col("event_type") == kind).only()
    out = side("click").latest(side("purchase"), on="ts")
    return out.select("source", F.col("item1.event_id").alias("id1"), F.col("item2.event_id").alias("id2"))


@query("""
WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 1500000000, false) AS gap FROM events),
c AS (SELECT *, bool_or(gap) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone FROM g) SELECT event_id FROM c WHERE NOT gone""")
def inactivity_cut_global(spark, sf_dir):
    return events(spark, sf_dir, ()).until_inactive(1500).df.select("event_id")


@query(f"""
WITH r AS (SELECT user_id, pos, unnest(list_distinct(list(event_type) OVER w)) AS kind FROM ({POS}) WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
n AS (SELECT r.user_id, r.pos, r.kind, count(*) AS n FROM r JOIN ({POS}) p ON p.user_id = r.user_id AND p.pos <= r.pos AND p.event_type = r.kind GROUP BY ALL)
SELECT user_id, pos, string_agg(kind || '=' || n, ',' ORDER BY kind) AS histogram FROM n GROUP BY ALL""")
def running_histogram(spark, sf_dir):
    out = events(spark, sf_dir).running_histogram("event_type")
    entries = F.array_sort(F.map_entries("histogram"))
    return out.select("user_id", "pos", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


# -- sub-flows


def _lines(spark, sf_dir) -> Flow:
    return create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").map(r_regionkey=F.col("n_regionkey")).only("r_regionkey")


_SUBS = """SELECT r_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS inner_pos, n_nationkey, row_number() OVER (ORDER BY r_regionkey) AS p FROM region JOIN nation ON r_regionkey = n_regionkey"""


@query(f"SELECT row_number() OVER (ORDER BY r_regionkey, inner_pos) AS pos, r_regionkey, n_nationkey FROM ({_SUBS})")
def flat_map_concat(spark, sf_dir):
    out = create.table(spark, f"{sf_dir}/region.parquet", "r_regionkey").sub_flows(_lines(spark, sf_dir), ["r_regionkey"])
    return out.like(out.with_pos()).df.select("pos", "r_regionkey", F.col("sub.n_nationkey").alias("n_nationkey"))


@query(f"""
WITH t AS (SELECT *, (dense_rank() OVER (ORDER BY r_regionkey) - 1) // 2 AS turn FROM ({_SUBS}))
SELECT row_number() OVER (ORDER BY turn, inner_pos, r_regionkey) AS pos, r_regionkey, n_nationkey FROM t""")
def flat_map_merge(spark, sf_dir):
    """Two sub-flows at a time take turns."""
    out = create.table(spark, f"{sf_dir}/region.parquet", "r_regionkey").sub_flows(_lines(spark, sf_dir), ["r_regionkey"], "merge", 2)
    return out.like(out.with_pos()).df.select("pos", "r_regionkey", F.col("sub.n_nationkey").alias("n_nationkey"))


@query("SELECT event_id, i::BIGINT AS inner_pos, event_id * 10 + i AS item FROM events, range(3) t(i) WHERE i < event_id % 4")
def concat_map_opaque(spark, sf_dir):
    out = events(spark, sf_dir, ()).concat_map("event_id", lambda v: (v * 10 + i for i in range(min(3, v % 4))), "long", inner="inner_pos")
    return out.df.select("event_id", "inner_pos", "item")


@query("SELECT event_id, value FROM events WHERE value > 90")
def collect_where(spark, sf_dir):
    """collect().where(...): a filter before the collector."""
    items = events(spark, sf_dir, ()).filter(F.col("value") > 90).collect_list(F.struct("event_id", "value"))
    return items.select(F.explode("items").alias("i")).select("i.*")


@query(f"SELECT user_id, ((pos - 1) // 4 + 1)::BIGINT AS seq, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS item FROM ({POS}) GROUP BY ALL")
def gather_window(spark, sf_dir):
    """Windows of four as a gatherer."""
    g = Gatherer(list, lambda s, v: [*s, v], lambda s, done: ([], s) if len(s) == 4 or done and s else None)
    return events(spark, sf_dir).gather("event_id", g, "array<long>").withColumn("item", text("item"))


# -- demand and overflow


@query(f"SELECT user_id, event_id, ((pos - 1) // 3 * 2.5)::DOUBLE AS released FROM ({POS})")
def pace_demand(spark, sf_dir):
    return events(spark, sf_dir).pace(3, 2.5).df.select("user_id", "event_id", "released")


#: A queue of {capacity} before a consumer that takes one item an hour; full, it loses new items.
QUEUE = f"""
WITH RECURSIVE p AS (SELECT user_id, event_id, pos, (epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) // 21600000000 AS tick FROM ({POS})),
q AS (SELECT user_id, event_id, pos, tick, 1::BIGINT AS waits, true AS kept FROM p WHERE pos = 1
  UNION ALL
  SELECT p.user_id, p.event_id, p.pos, p.tick, CASE WHEN greatest(0, waits - (p.tick - q.tick)) < {{capacity}} THEN greatest(0, waits - (p.tick - q.tick)) + 1 ELSE greatest(0, waits - (p.tick - q.tick)) END,
    greatest(0, waits - (p.tick - q.tick)) < {{capacity}}
  FROM q JOIN p ON p.user_id = q.user_id AND p.pos = q.pos + 1)
SELECT user_id, event_id, pos, tick + waits AS tick FROM q WHERE kept"""


@query(QUEUE.format(capacity=1 << 30))
def overflow_buffer(spark, sf_dir):
    return events(spark, sf_dir).overflow("event_id", 21600, 1, 1 << 30)


@query(QUEUE.format(capacity=1))
def overflow_queue_drop(spark, sf_dir):
    return events(spark, sf_dir).overflow("event_id", 21600, 1, 1, "drop")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(pos, (ts, event_id)) AS pos, tick + 1 AS tick FROM "
       f"(SELECT *, (epoch_us(ts) - epoch_us(first_value(ts) OVER {W})) // 21600000000 AS tick FROM ({POS})) GROUP BY user_id, tick")  # fmt: skip
def overflow_latest(spark, sf_dir):
    """A queue of one that keeps the latest item: the last one before each tick is taken."""
    return events(spark, sf_dir).overflow("event_id", 21600, 1, 1, "latest")


# -- failures


def _failing(spark, sf_dir, kind: str, limit: float) -> Flow:
    flow = events(spark, sf_dir, ()).filter(F.col("event_type") == kind)
    return flow.map(on_null="keep", error=F.when(F.col("value") > limit, F.concat(F.lit(f"{kind} "), F.col("event_id").cast("string"))))


_CUT = "SELECT * FROM (SELECT *, bool_or(value > {limit}) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone FROM events WHERE event_type = '{kind}') WHERE NOT gone"


@query(f"SELECT 0 AS source, event_id FROM ({_CUT.format(kind='click', limit=99.5)}) UNION ALL SELECT 1, event_id FROM ({_CUT.format(kind='purchase', limit=98)})")
def collect_failures_concat(spark, sf_dir):
    out, _ = _failing(spark, sf_dir, "click", 99.5).collect_failures(_failing(spark, sf_dir, "purchase", 98), error="error")
    return out.df.select("source", "event_id")


@query(f"""
WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM ({_CUT.format(kind='click', limit=99.5)})), b AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM ({_CUT.format(kind='purchase', limit=98)}))
SELECT a.pos, a.event_id AS id1, b.event_id AS id2 FROM a JOIN b USING (pos)""")
def collect_failures_zip(spark, sf_dir):
    out, _ = _failing(spark, sf_dir, "click", 99.5).collect_failures(_failing(spark, sf_dir, "purchase", 98), error="error", combine="zip")
    return out.select("pos", F.col("item1.event_id").alias("id1"), F.col("item2.event_id").alias("id2"))


@query("""
SELECT 'multiple failures: click ' || (SELECT arg_min(event_id, (ts, event_id)) FROM events WHERE event_type = 'click' AND value > 80) || '; purchase ' || (SELECT arg_min(event_id, (ts, event_id)) FROM events WHERE event_type = 'purchase' AND value > 80) AS failure""")
def collect_failures_composite(spark, sf_dir):
    """The message of the failure that the combination ends with."""
    out, failures = _failing(spark, sf_dir, "click", 80).collect_failures(_failing(spark, sf_dir, "purchase", 80), error="error")
    return _message(spark, fail_with_all(out.df, failures), r"multiple failures: click \d+; purchase \d+")


def _message(spark, df, pattern: str):
    import re

    try:
        df.write.format("noop").mode("overwrite").save()
        found = None
    except Exception as e:  # noqa: BLE001
        found = re.search(pattern, str(e))
    return spark.createDataFrame([(found.group(0) if found else None,)], "failure string")


@query("SELECT 'too much: ' || (SELECT arg_min(event_id, (ts, event_id)) FROM (SELECT * FROM events ORDER BY value DESC, ts, event_id LIMIT 1)) AS failure")
def transform_failure(spark, sf_dir):
    """The failure of an item, with a message of one's own."""
    flow = events(spark, sf_dir, ())
    worst = flow.df.agg(F.max("value")).first()[0]
    first = flow.filter(F.col("value") == worst).first(1)
    return _message(spark, first.transform_failure(F.col("value") == worst, F.concat(F.lit("too much: "), F.col("event_id").cast("string"))).df, r"too much: \d+")


@query("SELECT user_id, event_id FROM (SELECT *, bool_or(value > 95) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone, bool_or(value > 95) OVER (PARTITION BY user_id) AS failed FROM events) WHERE NOT gone OR failed AND event_type = 'click' UNION ALL "
       "SELECT user_id, event_id FROM (SELECT *, bool_or(value > 95) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone, bool_or(value > 95) OVER (PARTITION BY user_id) AS failed FROM events) WHERE NOT gone AND failed AND event_type = 'click'")  # fmt: skip
def recover_with_flow_by_key(spark, sf_dir):
    flow = events(spark, sf_dir)
    return flow.recover_with(F.col("value") > 95, flow.filter(F.col("event_type") == "click")).df.select("user_id", "event_id")



