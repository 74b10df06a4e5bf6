"""Registry of the engine's own queries: name to callable, name to oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..flow import Flow
from ..operators.fold import Gatherer
from ..operators.stats import exact
from ..sources import create
from ..streaming import flows as streaming
from .register import ANCHORED, GPOS, ORACLES, POS, QUERIES, RUN, W, query  # noqa: F401
from .register import events as _events
from .register import orders as _orders
from .register import text as _text
from .stages import compile_stages


@query(f"""
WITH d AS (SELECT *, lag(event_type) OVER {W} AS before FROM events),
k AS (SELECT *, row_number() OVER {W} AS pos FROM d WHERE before IS DISTINCT FROM event_type),
r AS (SELECT *, (pos - 1) // 5 AS batch, sum(value::DECIMAL(18,2)) OVER {RUN} AS s FROM k)
SELECT user_id, batch::BIGINT AS batch, count(*) AS size, max(pos)::BIGINT AS last_pos, round(max_by(s, pos)::DOUBLE / max(pos), 6) AS running_mean FROM r GROUP BY ALL""")
def entry_user_batches(spark, sf_dir):
    """Per user: drop repeats of event_type, batch by five, running mean of value at each batch."""
    flow = _events(spark, sf_dir).only("event_type", "value").skip_repetitions("event_type")
    flow = flow.scan_native("s", F.sum(exact(F.col("value"))))
    rows = flow.window_rows(5, name="batch")
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("size"), F.max("pos").alias("last_pos"), F.max_by("s", "pos").alias("s")).select("user_id", "batch", "size", "last_pos", F.round(F.col("s").cast("double") / F.col("last_pos"), 6).alias("running_mean"))


@query("SELECT event_id, upper(event_type) AS kind, round(value * 2, 4) AS twice FROM events")
def map_items(spark, sf_dir):
    return _events(spark, sf_dir).map(kind=F.upper("event_type"), twice=F.round(F.col("value") * 2, 4)).df.select("event_id", "kind", "twice")


@query("SELECT event_id FROM events WHERE value > 50 AND event_type = 'click'")
def filter_where(spark, sf_dir):
    return _events(spark, sf_dir).filter((F.col("value") > 50) & (F.col("event_type") == "click")).df.select("event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER {W} AS pos FROM events WHERE value > 20) WHERE pos <= 2")
def filter_limit(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.col("value") > 20, limit=2).df.select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def skip_where(spark, sf_dir):
    return _events(spark, sf_dir).skip_where(F.col("value") > 50).df.select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def select_when(spark, sf_dir):
    rich = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return _orders(spark, sf_dir).when(rich, ["o_custkey"]).df.select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def skip_when(spark, sf_dir):
    rich = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return _orders(spark, sf_dir).when(rich, ["o_custkey"], negate=True).df.select("o_orderkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def transform_to_uni_lookup(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return _orders(spark, sf_dir).enrich(names, ["o_custkey"]).df.select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT event_id, cast(value AS BIGINT) AS whole FROM (SELECT event_id, floor(value) AS value FROM events)")
def cast_to(spark, sf_dir):
    return _events(spark, sf_dir).map(whole=F.floor("value")).cast_to(whole="long").df.select("event_id", "whole")


@query("SELECT event_id FROM events WHERE false")
def ignore_items(spark, sf_dir):
    return _events(spark, sf_dir).ignore().df.select("event_id")


@query("SELECT event_id, (i - 1)::INT AS pos, word FROM (SELECT event_id, unnest(string_split(event_type, 'i')) AS word, generate_subscripts(string_split(event_type, 'i'), 1) AS i FROM events)")
def flatmap_iterable(spark, sf_dir):
    return _events(spark, sf_dir).flat_map(F.split("event_type", "i"), "word", "pos").df.select("event_id", "pos", "word")


@query("SELECT p_partkey, (i - 1)::INT AS inner_pos, word AS p_name FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def disjoint(spark, sf_dir):
    flow = Flow(spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("p_name", F.split("p_name", " ")), "p_partkey")
    return flow.disjoint("p_name", "inner_pos").df.select("p_partkey", "inner_pos", "p_name")


@query("SELECT event_id, 'eu' AS region FROM events")
def attach_context(spark, sf_dir):
    return _events(spark, sf_dir).with_context({"region": "eu"}).df.select("event_id", F.col("context")["region"].alias("region"))


@query("SELECT event_type AS kind, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def split_by_key(spark, sf_dir):
    flow = _events(spark, sf_dir)
    keys = sorted(r[0] for r in flow.df.select("event_type").distinct().collect())
    parts = flow.split(F.col("event_type"), keys)
    frames = [p.df.groupBy(F.lit(k).alias("kind")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")) for k, p in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(f"SELECT event_id, pos - 1 AS index FROM ({GPOS})")
def index_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).index().df.select("event_id", "index")


@query(f"SELECT user_id, event_id, pos FROM ({POS}) WHERE pos <= 3")
def select_first_n(spark, sf_dir):
    return _events(spark, sf_dir).first(3).pipe(lambda f: f.like(f.with_pos())).df.select("user_id", "event_id", "pos")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 100")
def select_first_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).first(100).df.select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 2")
def select_last_n(spark, sf_dir):
    return _events(spark, sf_dir).last(2).df.select("user_id", "event_id")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def select_last_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).last(50).df.select("event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, bool_or(value >= 60) OVER {RUN} AS gone FROM events) WHERE NOT gone")
def take_while(spark, sf_dir):
    return _events(spark, sf_dir).take_while(F.col("value") < 60).df.select("user_id", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, bool_or(value >= 60) OVER {RUN} AS gone FROM events) WHERE gone")
def drop_while(spark, sf_dir):
    return _events(spark, sf_dir).drop_while(F.col("value") < 60).df.select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT *, bool_or(value >= 99) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone FROM events) WHERE NOT gone")
def take_while_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).take_while(F.col("value") < 99).df.select("event_id")


@query(f"SELECT user_id, event_id FROM ({POS}) WHERE pos > 4")
def skip_first(spark, sf_dir):
    return _events(spark, sf_dir).skip_first(4).df.select("user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 3")
def skip_last(spark, sf_dir):
    return _events(spark, sf_dir).skip_last(3).df.select("user_id", "event_id")


@query(f"SELECT event_id FROM ({GPOS}) WHERE pos <= (SELECT count(*) FROM events) - 70")
def skip_last_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).skip_last(70).df.select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS t0 FROM events) WHERE ts < t0 + INTERVAL 2 DAY")
def first_duration(spark, sf_dir):
    return _events(spark, sf_dir).first_for("2 days").df.select("user_id", "event_id")


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 3 DAY")
def skip_duration(spark, sf_dir):
    return _events(spark, sf_dir, ()).skip_for("3 days").df.select("event_id")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_first(spark, sf_dir):
    return _events(spark, sf_dir, ()).distinct("event_type").df.select("event_type", "event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY lower(substr(event_type, 1, 1)) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_comparator(spark, sf_dir):
    return _events(spark, sf_dir, ()).distinct(F.lower(F.substring("event_type", 1, 1))).df.select("event_id")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def distinct_by_key(spark, sf_dir):
    return _events(spark, sf_dir).distinct("event_type").df.select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER {W} AS before, row_number() OVER {W} AS pos FROM events) WHERE pos = 1 OR before IS DISTINCT FROM event_type")
def skip_repetitions(spark, sf_dir):
    return _events(spark, sf_dir).skip_repetitions("event_type").df.select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS before, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events) WHERE pos = 1 OR before IS DISTINCT FROM event_type")
def skip_repetitions_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).skip_repetitions("event_type").df.select("event_id")


@query(f"SELECT user_id, ((pos - 1) // 4)::BIGINT AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM ({POS}) GROUP BY ALL")
def buffer_n(spark, sf_dir):
    return _events(spark, sf_dir).buffer("event_id", 4).withColumn("items", _text("items"))


@query(f"SELECT user_id, ((pos - 1) // 3)::BIGINT AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM ({POS}) WHERE (pos - 1) % 3 < 2 GROUP BY ALL")
def buffer_n_skip_gap(spark, sf_dir):
    return _events(spark, sf_dir).buffer("event_id", 2, 3).withColumn("items", _text("items"))


@query(f"SELECT user_id, k AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM (SELECT *, unnest(range(greatest(0, pos - 3), pos)) AS k FROM ({POS})) GROUP BY ALL")
def buffer_n_overlap(spark, sf_dir):
    return _events(spark, sf_dir).buffer("event_id", 3, 1).withColumn("items", _text("items"))


@query(f"SELECT event_id, ((pos - 1) // 100)::BIGINT AS window_id FROM ({GPOS})")
def window_n_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).window_rows(100).select("event_id", "window_id")


@query(f"""
WITH p AS ({POS}), c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT p.user_id, k, event_id, pos, n FROM (SELECT *, unnest(range(greatest(0, pos - 6), pos)) AS k FROM p) p JOIN c USING (user_id))
SELECT user_id, k AS window_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM w WHERE k <= greatest(0, n - 6 + 1) AND (n >= 6 OR k = 0) GROUP BY ALL""")
def sliding_window(spark, sf_dir):
    return _events(spark, sf_dir).sliding("event_id", 6).withColumn("items", _text("items"))


@query("""
WITH b AS (SELECT user_id, min(ts) AS t0, max(ts) AS t1 FROM events GROUP BY 1),
k AS (SELECT user_id, t0, unnest(range(0, (epoch_us(t1) - epoch_us(t0)) // 86400000000 + 1)) AS k FROM b),
c AS (SELECT e.user_id, (epoch_us(ts) - epoch_us(t0)) // 86400000000 AS k, count(*) AS n FROM events e JOIN b ON e.user_id = b.user_id GROUP BY ALL)
SELECT k.user_id, epoch_us(t0) + k.k * 86400000000 AS start_us, coalesce(n, 0) AS n FROM k LEFT JOIN c ON k.user_id = c.user_id AND k.k = c.k""")
def window_time_fixed_with_empty(spark, sf_dir):
    return _events(spark, sf_dir).time_windows("1 day").select("user_id", F.unix_micros("window_start").alias("start_us"), "n")


@query(ANCHORED.format(key="user_id", name="user_id", limit=1 << 40))
def buffer_time_anchored(spark, sf_dir):
    return _events(spark, sf_dir).buffer_for(86400.0).groupBy("user_id", "buffer_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query(ANCHORED.format(key="user_id", name="user_id", limit=3))
def buffer_size_or_delay(spark, sf_dir):
    return _events(spark, sf_dir).buffer_for(86400.0, 3).groupBy("user_id", "buffer_id").agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query(f"SELECT user_id, event_id, sum(value::DECIMAL(18,2)) OVER {RUN}::DOUBLE AS scan FROM events")
def scan_sum(spark, sf_dir):
    return _events(spark, sf_dir).scan_native("scan", F.sum(exact(F.col("value")))).df.select("user_id", "event_id", F.col("scan").cast("double").alias("scan"))


@query(f"SELECT user_id, pos, 1000 + sum(event_id) OVER {RUN}::BIGINT AS scan FROM ({POS}) UNION ALL SELECT DISTINCT user_id, 0, 1000 FROM events")
def scan_seed(spark, sf_dir):
    return _events(spark, sf_dir).scan_seeded("event_id", 1000, lambda c: F.sum(c))


@query(f"SELECT user_id, pos, max(event_id) OVER {RUN} AS scan FROM ({POS})")
def scan_opaque(spark, sf_dir):
    return _events(spark, sf_dir).scan("event_id", lambda a, b: max(a, b), "long")


@query(f"WITH s AS (SELECT user_id, pos, sum(event_id) OVER {RUN}::BIGINT AS item FROM ({POS})) SELECT user_id, pos AS seq, item FROM s UNION ALL SELECT user_id, max(pos) + 1, max_by(item, pos) FROM s GROUP BY 1")
def gather_scan(spark, sf_dir):
    return _events(spark, sf_dir).gather_scan("event_id", lambda a, b: a + b, 0, "long")


@query("SELECT user_id, sum(event_id)::BIGINT AS fold FROM events GROUP BY 1")
def gather_fold(spark, sf_dir):
    return _events(spark, sf_dir).fold("event_id", F.lit(0).cast("long"), lambda a, x: a + x)


@query(f"SELECT user_id, ((pos - 1) // 7 + 1)::BIGINT AS seq, sum(event_id)::BIGINT AS item FROM ({POS}) GROUP BY ALL")
def gather_custom(spark, sf_dir):
    """A gatherer that sums seven items at a time, and the rest at the end."""
    g = Gatherer(lambda: [], lambda s, v: [*s, v], lambda s, done: (s[7:], sum(s[:7])) if len(s) >= 7 or done and s else None)
    return _events(spark, sf_dir).gather("event_id", g, "long")


@query(f"SELECT user_id, event_id, count(*) OVER {RUN} AS count FROM events")
def running_count(spark, sf_dir):
    return _events(spark, sf_dir).running_count().df.select("user_id", "event_id", "count")


@query(f"SELECT user_id, event_id, sum(value::DECIMAL(18,2)) OVER {RUN}::DOUBLE AS sum FROM events")
def running_sum(spark, sf_dir):
    return _events(spark, sf_dir).running_sum("value", digits=2).df.select("user_id", "event_id", "sum")


@query(f"SELECT user_id, event_id, sum(value::DECIMAL(18,2)) OVER {RUN}::DOUBLE / count(value) OVER {RUN} AS average FROM events")
def running_avg(spark, sf_dir):
    return _events(spark, sf_dir).running_average("value", digits=2).df.select("user_id", "event_id", "average")


@query("SELECT event_id, count(*) OVER w AS count, (sum(value::DECIMAL(18,2)) OVER w)::DOUBLE AS sum FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_totals_global(spark, sf_dir):
    return _events(spark, sf_dir, ()).running_totals("value", digits=2).df.select("event_id", "count", F.col("sum").cast("double").alias("sum"))


@query(f"SELECT user_id, pos, quantile_cont(value, 0.5) OVER {RUN} AS median FROM ({POS})")
def running_median(spark, sf_dir):
    return _events(spark, sf_dir).running_median("value")


@query("SELECT user_id, event_id, value FROM (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value < b")
def running_min_records(spark, sf_dir):
    return _events(spark, sf_dir).min_records("value").df.select("user_id", "event_id", "value")


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE b IS NULL OR value > b")
def running_max_records(spark, sf_dir):
    return _events(spark, sf_dir).max_records("value").df.select("user_id", "event_id", "value")


@query(f"""
WITH t AS (SELECT user_id, pos, array_to_string(list_slice(list_reverse_sort(list_distinct(list((value * 100)::BIGINT) OVER {RUN})), 1, 3), ',') AS top FROM ({POS})),
l AS (SELECT *, lag(top) OVER (PARTITION BY user_id ORDER BY pos) AS before FROM t)
SELECT user_id, pos, top FROM l WHERE before IS DISTINCT FROM top""")
def running_top3(spark, sf_dir):
    flow = _events(spark, sf_dir).map(cents=(exact(F.col("value")) * 100).cast("long"))
    return flow.running_top("cents", 3, "long").withColumn("top", _text("top"))


#: Moments from exact sums of powers of cents, over the window {w}.
MOMENTS = """
WITH c AS (SELECT *, (value::DECIMAL(18,2) * 100)::BIGINT::HUGEINT AS u FROM events),
s AS (SELECT user_id, event_id, count(value) OVER w AS n, (sum(u) OVER w)::HUGEINT AS s1, (sum(u * u) OVER w)::HUGEINT AS s2, (sum(u * u * u) OVER w)::HUGEINT AS s3, (sum(u * u * u * u) OVER w)::HUGEINT AS s4,
  min(value) OVER w AS min, max(value) OVER w AS max FROM c WINDOW w AS {w}),
m AS (SELECT *, (n * s2 - s1 * s1)::DOUBLE AS d2, (n * n * s3 - 3 * n * s1 * s2 + 2 * s1 * s1 * s1)::DOUBLE AS d3, (n * n * n * s4 - 4 * n * n * s1 * s3 + 6 * n * s1 * s1 * s2 - 3 * s1 * s1 * s1 * s1)::DOUBLE AS d4 FROM s)
SELECT user_id, event_id, n AS count, s1::DOUBLE / n / 100.0::DOUBLE AS average, CASE WHEN n > 1 THEN d2 / (n * (n - 1))::DOUBLE / 10000.0::DOUBLE ELSE 'nan'::DOUBLE END AS variance,
  CASE WHEN n > 1 THEN sqrt(d2 / (n * (n - 1))::DOUBLE / 10000.0::DOUBLE) ELSE 'nan'::DOUBLE END AS stddev,
  CASE WHEN d2 > 0 THEN round(d3 / d2 ** 1.5, 5) + 0.0 ELSE 'nan'::DOUBLE END AS skewness, CASE WHEN d2 > 0 THEN round(d4 / (d2 * d2) - 3, 5) + 0.0 ELSE 'nan'::DOUBLE END AS kurtosis, min, max FROM m"""


def _all_moments(flow: Flow) -> DataFrame:
    at = flow.running_statistics("value", digits=2).df
    return at.select("user_id", "event_id", "count", "average", "variance", "stddev", *[(F.round(c, 5) + 0.0).alias(c) for c in ("skewness", "kurtosis")], "min", "max")


@query(MOMENTS.format(w=RUN))
def running_statistics(spark, sf_dir):
    return _all_moments(_events(spark, sf_dir))


@query(MOMENTS.format(w="(ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"))
def running_statistics_global(spark, sf_dir):
    return _all_moments(_events(spark, sf_dir, ()))


@query("""
WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM events GROUP BY 1),
c AS (SELECT event_type, any_value(n) AS n, any_value(m) AS m, sum((value - m) ** 2) / any_value(n) AS m2, sum((value - m) ** 3) / any_value(n) AS m3, sum((value - m) ** 4) / any_value(n) AS m4,
  min(value) AS min, max(value) AS max FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n AS count, round(m, 4) AS average, round(m2 * n / (n - 1), 4) AS variance, round(m3 / m2 ** 1.5, 4) AS skewness, round(m4 / (m2 * m2) - 3, 4) AS kurtosis, min, max FROM c""")
def statistics(spark, sf_dir):
    out = _events(spark, sf_dir, ("event_type",)).statistics("value")
    return out.select("event_type", "count", *[F.round(c, 4).alias(c) for c in ("average", "variance", "skewness", "kurtosis")], "min", "max")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def occurrence(spark, sf_dir):
    return _events(spark, sf_dir).occurrences("event_type")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS occurrence FROM events")
def running_occurrence(spark, sf_dir):
    return _events(spark, sf_dir).running_occurrence("event_type").df.select("user_id", "event_id", "occurrence")


@query("SELECT DISTINCT value FROM events ORDER BY value DESC LIMIT 5")
def top_n(spark, sf_dir):
    return _events(spark, sf_dir, ()).top("value", 5)


_SIDE = "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events WHERE event_type = '{}'"


def _side(spark, sf_dir, kind: str) -> Flow:
    return _events(spark, sf_dir).filter(F.col("event_type") == kind).only()


@query(f"SELECT a.user_id, a.pos, a.event_id AS id1, b.event_id AS id2 FROM ({_SIDE.format('click')}) a JOIN ({_SIDE.format('purchase')}) b ON a.user_id = b.user_id AND a.pos = b.pos")
def zip2(spark, sf_dir):
    out = _side(spark, sf_dir, "click").zip(_side(spark, sf_dir, "purchase"))
    return out.select("user_id", "pos", F.col("item1.event_id").alias("id1"), F.col("item2.event_id").alias("id2"))


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pos FROM orders), c AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS pos FROM customer),
p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS pos FROM part)
SELECT pos, o_orderkey, c_custkey, p_partkey FROM o JOIN c USING (pos) JOIN p USING (pos)""")
def zip3(spark, sf_dir):
    customers = create.table(spark, f"{sf_dir}/customer.parquet", "c_custkey").only()
    parts = create.table(spark, f"{sf_dir}/part.parquet", "p_partkey").only()
    out = _orders(spark, sf_dir, ()).only().zip(customers, parts)
    return out.select("pos", F.col("item1.o_orderkey").alias("o_orderkey"), F.col("item2.c_custkey").alias("c_custkey"), F.col("item3.p_partkey").alias("p_partkey"))


@query("""
WITH u AS (SELECT user_id, ts, 0 AS source, event_id, event_id AS a, NULL AS b FROM events WHERE event_type = 'click' UNION ALL
  SELECT user_id, ts, 1, event_id, NULL, event_id FROM events WHERE event_type = 'purchase'),
f AS (SELECT user_id, source, last_value(a IGNORE NULLS) OVER w AS id1, last_value(b IGNORE NULLS) OVER w AS id2 FROM u
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, source, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, source, id1, id2 FROM f WHERE id1 IS NOT NULL AND id2 IS NOT NULL""")
def combine_latest(spark, sf_dir):
    out = _side(spark, sf_dir, "click").latest(_side(spark, sf_dir, "purchase"), on="ts")
    return out.select("user_id", "source", F.col("item1.event_id").alias("id1"), F.col("item2.event_id").alias("id2"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def merge(spark, sf_dir):
    return _side(spark, sf_dir, "click").merge(_side(spark, sf_dir, "purchase")).df.select("event_id")


@query("""SELECT source, event_id, row_number() OVER (ORDER BY source, ts, event_id) AS pos FROM (SELECT CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS source, * FROM events WHERE event_type IN ('click', 'purchase'))""")
def concat(spark, sf_dir):
    flow = _side(spark, sf_dir, "purchase").concat(_side(spark, sf_dir, "click")).group_by()
    return flow.with_pos().select("source", "event_id", "pos")


@query("SELECT event_type, n, row_number() OVER (ORDER BY t, e) AS seen FROM (SELECT event_type, count(*) AS n, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM events GROUP BY 1)")
def group_by_first_seen(spark, sf_dir):
    groups = _events(spark, sf_dir, ("event_type",)).groups()
    return Flow(groups, "first_seen").with_pos("seen").select("event_type", "n", "seen")


@query("SELECT user_id, arg_min(event_id, (ts, event_id)) AS first FROM events GROUP BY 1")
def collect_first(spark, sf_dir):
    return _events(spark, sf_dir).collect_first("event_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS last FROM events GROUP BY 1")
def collect_last(spark, sf_dir):
    return _events(spark, sf_dir).collect_last("event_id")


@query("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS items FROM events GROUP BY 1")
def collect_list(spark, sf_dir):
    return _events(spark, sf_dir).collect_list("event_id").withColumn("items", _text("items"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM events GROUP BY 1")
def collect_set(spark, sf_dir):
    return _events(spark, sf_dir).collect_set("event_type").withColumn("items", _text("items"))


@query("SELECT n_nationkey AS key, n_name AS value FROM nation")
def collect_map(spark, sf_dir):
    return create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").collect_map("n_nationkey", "n_name").select(F.explode("map").alias("key", "value"))


@query("SELECT user_id, event_type AS key, sum(event_id)::BIGINT AS value FROM events GROUP BY ALL")
def collect_map_merge(spark, sf_dir):
    return _events(spark, sf_dir).collect_map("event_type", "event_id", merge=F.sum("event_id")).select("user_id", F.explode("map").alias("key", "value"))


@query("SELECT user_id, event_type AS key, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS value FROM events GROUP BY ALL")
def collect_multimap(spark, sf_dir):
    return _events(spark, sf_dir).collect_multimap("event_type", "event_id").select("user_id", F.explode("map").alias("key", "value")).withColumn("value", _text("value"))


@query("SELECT user_id, count(*) AS n, min(value) AS least, bool_and(value >= 0) AS good FROM events GROUP BY 1")
def collect_with(spark, sf_dir):
    return _events(spark, sf_dir).collect_with(n=F.count("*"), least=F.min("value"), good=F.bool_and(F.col("value") >= 0))


@query("SELECT user_id, sum(event_id)::BIGINT AS fold FROM events GROUP BY 1")
def collect_in(spark, sf_dir):
    return _events(spark, sf_dir).collect_in("event_id", F.lit(0).cast("long"), lambda a, x: a + x)


@query("SELECT n_nationkey FROM nation")
def if_empty(spark, sf_dir):
    nations = create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").only()
    return nations.filter(F.col("n_nationkey") < 0).if_empty(nations).df.select("n_nationkey")


@query("SELECT 0 AS source, n_nationkey::BIGINT AS id FROM nation UNION ALL SELECT 1, r_regionkey FROM region")
def on_completion_switch(spark, sf_dir):
    nations = Flow(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")), "id")
    regions = Flow(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id")), "id")
    return nations.then(regions).df.select("source", "id")


_FAILED = f"SELECT *, bool_or(value > 95) OVER {RUN} AS gone, coalesce(bool_or(value > 95) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM events"


@query(f"SELECT user_id, event_id, CASE WHEN gone THEN -1 ELSE value END AS value FROM ({_FAILED}) WHERE NOT past")
def recover_with_item(spark, sf_dir):
    return _events(spark, sf_dir).recover_with_item(F.col("value") > 95, value=F.lit(-1.0)).df.select("user_id", "event_id", "value")


@query(f"SELECT user_id, event_id FROM ({_FAILED}) WHERE NOT gone")
def recover_with_completion(spark, sf_dir):
    return _events(spark, sf_dir).recover_with_completion(F.col("value") > 95).df.select("user_id", "event_id")


@query("""
WITH g AS (SELECT *, bool_or(value > 99) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS gone FROM events)
SELECT 0 AS source, event_id FROM g WHERE NOT gone UNION ALL SELECT 1, event_id FROM events WHERE event_type = 'click' AND (SELECT bool_or(value > 99) FROM events)""")
def recover_with_flow(spark, sf_dir):
    flow = _events(spark, sf_dir, ())
    return flow.recover_with(F.col("value") > 99, flow.filter(F.col("event_type") == "click")).df.select("source", "event_id")


@query(f"""
WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER {W}) > 432000000000, false) AS gap FROM events),
c AS (SELECT *, bool_or(gap) OVER {RUN} AS gone FROM g) SELECT user_id, event_id FROM c WHERE NOT gone""")
def inactivity_cut(spark, sf_dir):
    return _events(spark, sf_dir).until_inactive(5 * 86400).df.select("user_id", "event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def overflow_keep_last(spark, sf_dir):
    return _events(spark, sf_dir, ()).keep_last_per("1 day").df.select("event_id")


@query("SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r <= 1")
def overflow_drop(spark, sf_dir):
    return _events(spark, sf_dir).drop_beyond("1 day", 1).df.select("event_id")


@query("SELECT turn::INT AS turn, r_regionkey, r_name FROM region, range(3) t(turn)")
def repeat_at_most(spark, sf_dir):
    return create.repeat_at_most(create.table(spark, f"{sf_dir}/region.parquet", "r_regionkey"), 3).df.select("turn", "r_regionkey", "r_name")


@query("SELECT p_partkey FROM part WHERE p_partkey < (SELECT min(p_partkey) FROM part WHERE p_size > 45)")
def repeat_until(spark, sf_dir):
    return create.repeat_until(create.table(spark, f"{sf_dir}/part.parquet", "p_partkey"), F.col("p_size") > 45).df.select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_partkey <= (SELECT min(p_partkey) FROM part WHERE p_size > 45)")
def repeat_whilst(spark, sf_dir):
    return create.repeat_whilst(create.table(spark, f"{sf_dir}/part.parquet", "p_partkey"), F.col("p_size") <= 45).df.select("p_partkey")


@query("SELECT 0 AS source, r_regionkey::BIGINT AS id FROM region UNION ALL SELECT 1, n_nationkey FROM (SELECT n_nationkey FROM nation ORDER BY 1 DESC LIMIT 4)")
def replay_last_n_seed(spark, sf_dir):
    nations = Flow(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id")), "id")
    regions = Flow(spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("id")), "id")
    return create.replay(nations, 4, regions).df.select("source", "id")


@query("SELECT (i + 1)::BIGINT AS pos, (i + 5)::INT AS item FROM range(20) t(i)")
def range_source(spark, sf_dir):
    return create.range_(spark, 5, 25).df


@query("WITH RECURSIVE f(pos, a, b) AS (SELECT 1, 0::BIGINT, 1::BIGINT UNION ALL SELECT pos + 1, b, a + b FROM f WHERE pos < 40) SELECT pos::BIGINT AS pos, a AS item FROM f")
def generator_source(spark, sf_dir):
    return create.generator(spark, (0, 1), lambda s: ((s[1], s[0] + s[1]), [s[0]]) if s[0] < 100_000_000 else None, "bigint").first(40).df


@query("WITH RECURSIVE f(pos, x) AS (SELECT 1, 1::BIGINT UNION ALL SELECT pos + 1, x * 3 FROM f WHERE pos < 20) SELECT pos::INT AS pos, x FROM f")
def recurrence_source(spark, sf_dir):
    return create.recurrence(spark, "WITH RECURSIVE f(pos, x) AS (SELECT 1, 1L UNION ALL SELECT pos + 1, x * 3 FROM f WHERE pos < 20) SELECT pos, x FROM f").df


@query("SELECT i::BIGINT AS tick, 1704067200000000 + i * 3600000000 AS us FROM range(25) t(i)")
def ticks_source(spark, sf_dir):
    return create.ticks(spark, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "1 hour").df.select("tick", F.unix_micros("ts").alias("us"))


@query(f"""
WITH k AS (SELECT *, round(value, 1) AS v FROM events WHERE value > 10), s AS (SELECT *, row_number() OVER {W} AS pos FROM k)
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM s WHERE pos BETWEEN 3 AND 7 GROUP BY 1""")
def stage_graph(spark, sf_dir):
    out = compile_stages(_events(spark, sf_dir), [("filter", {"predicate": "value > 10"}), ("map", {"v": "round(value, 1)"}), ("skip", {"n": 2}), ("limit", {"n": 5}), ("collect", {"value": "event_id"})])
    return out.withColumn("items", _text("items"))


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return streaming.events(spark, sf_dir, "events.parquet", schema, "ts", late="40 days")


def _finished(spark, df, name: str, mode: str = "append") -> DataFrame:
    from ..storage import fresh_dir

    at = fresh_dir(spark, name)
    if mode == "complete":
        streaming.each_batch(df, lambda batch, number: batch.write.mode("overwrite").parquet(f"{at}/data"), f"{at}/checkpoint", mode="complete").awaitTermination()
    else:
        streaming.sink(df, f"{at}/data", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/data")


@query("SELECT event_type, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    df = streaming.tumbling(_stream(spark, sf_dir), "ts", "1 day", ["event_type"], n=F.count("*"), total=F.sum(exact(F.col("value"))))
    return _finished(spark, df, "stream-tumbling", "complete").select("event_type", F.unix_micros("window_start").alias("start_us"), "n", F.col("total").cast("double").alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf_dir):
    df = streaming.distinct(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), "user_id", "event_type")
    return _finished(spark, df, "stream-distinct").select("user_id", "event_type")


@query("SELECT event_id, value FROM events WHERE value > 50")
def stream_filter(spark, sf_dir):
    df = _stream(spark, sf_dir).where("value > 50").select("event_id", "value")
    return _finished(spark, df, "stream-filter")


from . import edges, results  # noqa: E402, F401  they register their queries
