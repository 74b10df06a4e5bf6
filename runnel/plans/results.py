"""Queries whose rows come from sources, single results, terminals and hooks: each calls the operator it is named after."""

from __future__ import annotations

import logging
import time
from concurrent.futures import ThreadPoolExecutor
from threading import Event

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CompositeFlowError, FlowTimeout
from ..flow import Flow, intercept
from ..functions import scalars
from ..policies import Uni, backoff_delays, broadcast_to, join_all, join_first, retry
from ..sources import create, emitters
from ..storage import fresh_dir
from ..streaming import flows as streaming
from ..testing import Spy, assert_completed, assert_failed, assert_items
from .register import POS, events, orders, query, text
from .stages import compile_stages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(spark: SparkSession, **values) -> DataFrame:
    """One row of whole numbers, or of texts."""
    kinds = {int: "long", str: "string", float: "double"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items()))


# -- sources


@query("SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, NULL), (4, 'a')) t(pos, item)")
def literal_items(spark, sf_dir):
    return create.items(spark, ["a", "b", None, "a"], "string").df


@query("SELECT i::BIGINT + 1 AS pos, (i * i)::INT AS item FROM range(100) t(i)")
def iterable_source(spark, sf_dir):
    return create.items(spark, (i * i for i in range(100)), "int").df


@query("SELECT 0::INT AS source, 1::BIGINT AS pos, 7 AS item")
def optional_and_empty(spark, sf_dir):
    """An optional item, an optional that has none, and an empty flow, one after another."""
    return create.optional(spark, 7, "int").concat(create.optional(spark, None, "int"), create.empty(spark)).df


@query("SELECT 0::BIGINT AS items, 1::BIGINT AS unfinished")
def nothing_source(spark, sf_dir):
    """A stream without items: it is still there when the wait is over."""
    q = emitters.never(spark).writeStream.format("noop").trigger(processingTime="100 milliseconds").option("checkpointLocation", fresh_dir(spark, "nothing")).start()
    try:
        ended = q.awaitTermination(2)
        rows = sum(int(p.numInputRows) for p in q.recentProgress)
    finally:
        q.stop()
    return _row(spark, items=rows, unfinished=int(not ended))


@query("SELECT 'boom' AS failure")
def failure_source(spark, sf_dir):
    return _row(spark, failure="boom" if "boom" in assert_failed(create.failure(spark, "boom")) else "")


@query("SELECT i + 1 AS pos, (3 * i)::BIGINT AS item FROM range(1000) t(i)")
def emitter_source(spark, sf_dir):
    return emitters.emitter(spark, lambda: (3 * i for i in range(1000)), "long").df


def _streamed(spark, df: DataFrame, name: str) -> DataFrame:
    at = fresh_dir(spark, name)
    streaming.sink(df, f"{at}/data", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/data")


@query("SELECT 'buffer' AS strategy, i + 1 AS pos, i AS item FROM range(100) t(i) UNION ALL SELECT 'drop', i + 1, i FROM range(10) t(i) UNION ALL SELECT 'latest', i + 1, i FROM range(90, 100) t(i)")
def emitter_overflow(spark, sf_dir):
    """A hundred items at once for a capacity of ten: all in turn, the first ten, or the last ten."""
    frames = []
    for strategy in ("buffer", "drop", "latest"):
        got = _streamed(spark, emitters.stream(spark, lambda at: range(at, 100), "long", strategy, 100 if strategy == "buffer" else 10), f"emitter-{strategy}")
        frames.append(got.select(F.lit(strategy).alias("strategy"), "pos", "item"))
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("SELECT 'opened,closed' AS completed, 'opened,failed boom' AS failed")
def resource_source(spark, sf_dir):
    """What the finalizers of a resource write down, after completion and after a failure."""
    at = fresh_dir(spark, "resource").removeprefix("file://")
    said = {}
    for name, emit in (("completed", lambda r: iter([1, 2])), ("failed", _breaks)):
        path = f"{at}-{name}"
        tell = lambda what, path=path: open(path, "a").write(f"{what}\n") and path  # noqa: E731, SIM115
        flow = emitters.emitter(spark, emit, "int", lambda tell=tell: tell("opened"), lambda r, tell=tell: tell("closed"), lambda r, e, tell=tell: tell(f"failed {e}"))
        try:
            flow.df.collect()
        except Exception:  # noqa: BLE001
            assert name == "failed"
        said[name] = ",".join(dict.fromkeys(r[0] for r in spark.read.text(f"file://{path}").collect()))
    return _row(spark, **said)


def _breaks(resource):
    yield 1
    raise ValueError("boom")


@query("SELECT n_nationkey, 2 AS use FROM nation WHERE n_regionkey = 1")
def deferred_source(spark, sf_dir):
    """A flow that is built anew at each use, from a context; this is the second use."""

    def build(context: dict) -> Flow:
        context["use"] = context.get("use", 0) + 1
        return create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").filter(F.col("n_regionkey") == context["region"]).map(use=F.lit(context["use"]))

    flow = create.with_context(build, {"region": 1})
    assert_completed(flow.flow())
    return flow.flow().df.select("n_nationkey", "use")


@query("SELECT 0 AS source, n_nationkey::BIGINT AS item FROM nation UNION ALL SELECT 1, 5 UNION ALL SELECT 2, i FROM range(3) t(i) UNION ALL SELECT 3, count(*) FROM orders")
def adapted_sources(spark, sf_dir):
    """A DataFrame, a future, an iterable and a Uni as flows, one after another."""
    keys = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("item"), F.col("n_nationkey").cast("long").alias("pos"))
    with ThreadPoolExecutor(1) as pool:
        parts = [keys, pool.submit(lambda: [5]), range(3), Uni(_table(spark, sf_dir, "orders").count)]
        flows = [create.from_any(spark, p, "pos", "long") for p in parts]
    return flows[0].concat(*[f.like(f.df.select("item", "pos")) for f in flows[1:]]).df.select("source", "item")


# -- transforms that act beside the flow


@query("SELECT count(*) AS items, sum(event_id)::BIGINT AS ids, count(*) AS called FROM events")
def invoke_items(spark, sf_dir):
    """A side effect for each item, counted by an accumulator; the items pass unchanged."""
    calls = spark.sparkContext.accumulator(0)

    def call(event_id):
        calls.add(1)

    out = events(spark, sf_dir, ()).invoke(call, "event_id").df.agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).first()
    return _row(spark, items=out.n, ids=out.ids, called=calls.value)


@query("SELECT 'no such event' AS failure, 0::BIGINT AS quiet")
def fail_with(spark, sf_dir):
    """Any item is a failure; a flow without items has none."""
    flow = events(spark, sf_dir, ())
    message = assert_failed(flow.fail_with("no such event"))
    return _row(spark, failure="no such event" if "no such event" in message else message, quiet=flow.ignore().fail_with("x").df.count())


@query("SELECT user_id, sum(event_id)::BIGINT AS ids FROM (SELECT * FROM events WHERE value > 20) GROUP BY 1")
def plug_operator(spark, sf_dir):
    """An operator of one's own: a function from flow to flow."""

    def above(flow: Flow, limit: float) -> Flow:
        return flow.filter(F.col("value") > limit)

    return events(spark, sf_dir).pipe(above, 20).collect_with(ids=F.sum("event_id"))


@query("SELECT count(*) AS items, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events")
def log_and_spy(spark, sf_dir):
    """What a log says, and a spy counts, of an action's items."""
    said, done = [], Event()

    class Ear(logging.Handler):
        def emit(self, record):
            said.append(record.getMessage())
            done.set()

    logger = logging.getLogger(f"runnel.log_and_spy.{id(said)}")
    logger.setLevel(logging.INFO)
    logger.propagate = False
    logger.addHandler(Ear())
    spy = Spy("clicks")
    flow = spy.on(events(spark, sf_dir, ()).log("all", logger).map(on_null="keep", click=F.when(F.col("event_type") == "click", 1)), "click")
    flow.df.write.format("noop").mode("overwrite").save()
    done.wait(30)
    items = int(said[0].rsplit(" ", 1)[1].strip("}"))
    return _row(spark, items=items, clicks=spy.counts["n_click"])


@query("SELECT event_id, value * 2 AS twice, event_id + 1 AS next FROM events")
def opaque_functions(spark, sf_dir):
    """A column from a pandas function, and a whole batch through another."""
    flow = events(spark, sf_dir, ()).only("value").map_python(lambda v: v * 2, "twice", "double", "value")
    return flow.map_rows(lambda f: f.assign(next=f["event_id"] + 1), "event_id long, ts timestamp_ntz, value double, twice double, next long").df.select("event_id", "twice", "next")


@query("SELECT n_nationkey, n_name, n_regionkey + 1 AS up FROM nation")
def tuple_helpers(spark, sf_dir):
    t = scalars.map_item(scalars.tuple_of(F.col("n_name"), F.col("n_regionkey")), 2, lambda x: x + 1)
    flow = create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").map(t=t)
    return flow.df.select("n_nationkey", scalars.nth(F.col("t"), 1).alias("n_name"), scalars.nth(F.col("t"), 2).alias("up"))


# -- sharing, demand and streams


@query("SELECT count(*) AS items, max(value) AS best, count(DISTINCT user_id) AS users FROM events")
def broadcast_consumers(spark, sf_dir):
    """One run of the upstream for three consumers that work together."""
    n, best, users = broadcast_to(events(spark, sf_dir).df, lambda d: d.count(), lambda d: d.agg(F.max("value")).first()[0], lambda d: d.select("user_id").distinct().count(), together=True)
    return _row(spark, items=n, best=best, users=users)


@query("SELECT event_type, count(*) AS n, min(event_id) AS least FROM events GROUP BY 1")
def cache_items(spark, sf_dir):
    """Two consumers of a flow that is kept, and released after."""
    with events(spark, sf_dir, ("event_type",)).cache() as kept:
        counts = kept.collect_with(n=F.count("*")).collect()
        least = kept.collect_with(least=F.min("event_id")).collect()
    low = {r.event_type: r.least for r in least}
    return spark.createDataFrame([(r.event_type, r.n, low[r.event_type]) for r in counts], "event_type string, n long, least long")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def hot_stream(spark, sf_dir):
    """What a subscriber gets that joins on the 20th."""
    df = streaming.events(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema, "ts", late="40 days")
    return _streamed(spark, streaming.hot(df, "ts", "2024-01-20").select("event_id"), "hot")


@query("SELECT 'whole' AS part, count(*) AS items FROM events UNION ALL SELECT 'parts', (count(*) + 999) // 1000 FROM events UNION ALL SELECT 'overflow', 1")
def bounded_batches(spark, sf_dir):
    """Batches taken a thousand items at a time, and a batch that is more than the buffer holds."""
    stream = lambda: streaming.events(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema, "ts", late="40 days")
    sizes: list[int] = []
    streaming.each_batch(stream(), lambda b, n: sizes.append(b.count()), fresh_dir(spark, "capped"), cap=1000, order=["ts", "event_id"]).awaitTermination()
    try:
        streaming.each_batch(stream(), lambda b, n: None, fresh_dir(spark, "overflow"), capacity=10).awaitTermination()
        overflow = 0
    except Exception as e:  # noqa: BLE001
        overflow = int("items for 10" in str(e))
    assert max(sizes) <= 1000
    return spark.createDataFrame([("whole", sum(sizes)), ("parts", len(sizes)), ("overflow", overflow)], "part string, items long")


@query("SELECT 'buffer' AS strategy, 20::BIGINT AS items, 190::BIGINT AS total UNION ALL SELECT 'drop', 10, 45")
def pause_demand(spark, sf_dir):
    """Ten items, a pause in which ten more come, and a resumption: they are taken then, or passed over."""
    rows = []
    for strategy in ("buffer", "drop"):
        at, got = fresh_dir(spark, f"pause-{strategy}"), []
        put = lambda a, b, at=at: spark.range(a, b).coalesce(1).write.mode("append").parquet(f"{at}/source")
        put(0, 10)
        source = spark.readStream.schema("id long").parquet(f"{at}/source")
        flow = streaming.Pausable(source, lambda b, n, got=got: got.extend(r.id for r in b.collect()), f"{at}/checkpoint", strategy=strategy)
        flow.wait()
        flow.pause()
        assert flow.paused
        put(10, 20)
        flow.resume()
        flow.wait()
        flow.pause()
        rows.append((strategy, len(got), sum(got)))
    return spark.createDataFrame(rows, "strategy string, items long, total long")


@query("SELECT 1::BIGINT AS started, 1::BIGINT AS ended, count(*) AS items FROM events")
def lifecycle_hooks(spark, sf_dir):
    """Hooks of a stream: its start, its progress and its end."""
    seen: dict[str, int] = {"started": 0, "items": 0, "ended": 0}
    note = lambda name, by: lambda e: seen.__setitem__(name, seen[name] + by(e))
    hooks = streaming.listen(spark, note("started", lambda e: 1), note("items", lambda e: int(e.progress.numInputRows)), note("ended", lambda e: 1))
    try:
        df = streaming.events(spark, sf_dir, "events.parquet", _table(spark, sf_dir, "events").schema, "ts", late="40 days")
        streaming.each_batch(df, lambda b, n: b.write.format("noop").mode("overwrite").save(), fresh_dir(spark, "hooks")).awaitTermination()
        until = time.monotonic() + 20
        while not seen["ended"] and time.monotonic() < until:
            time.sleep(0.05)
    finally:
        spark.streams.removeListener(hooks)
    return _row(spark, started=seen["started"], ended=seen["ended"], items=seen["items"])


# -- terminals


@query("SELECT count(*) AS items, 1::BIGINT AS completed, 1::BIGINT AS failed FROM nation")
def subscribe_callbacks(spark, sf_dir):
    seen, ended, failed = [], [], []
    create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").subscribe(seen.append, on_completion=lambda: ended.append(1)).wait(60)
    create.failure(spark, "boom").subscribe(seen.append, on_failure=failed.append).wait(60)
    return _row(spark, items=len(seen), completed=len(ended), failed=len(failed))


@query("SELECT row_number() OVER (ORDER BY n_name DESC) AS at, n_name FROM nation")
def pull_rows(spark, sf_dir):
    """A blocking pull of rows in order."""
    names = _table(spark, sf_dir, "nation").withColumn("back", F.row_number().over(Window.orderBy(F.desc("n_name"))))
    return spark.createDataFrame([(i + 1, r.n_name) for i, r in enumerate(Flow(names, "back"))], "at long, n_name string")


@query("SELECT count(*) AS items, 'timeout' AS late, 'refused' AS never FROM orders")
def await_result(spark, sf_dir):
    """Results awaited: one in time, one too late, one with a wait that is none."""
    n = Uni(_table(spark, sf_dir, "orders").count).wait(600, spark)
    try:
        late = str(Uni(lambda: time.sleep(5)).wait(0.2, spark))
    except FlowTimeout:
        late = "timeout"
    try:
        never = str(Uni.item(1).wait(0, spark))
    except ValueError:
        never = "refused"
    return _row(spark, items=n, late=late, never=never)


@query("SELECT count(*) AS items FROM customer")
def export_future(spark, sf_dir):
    with ThreadPoolExecutor(1) as pool:
        return _row(spark, items=Uni(_table(spark, sf_dir, "customer").count).future(pool).result())


@query("SELECT (SELECT arg_min(n_name, n_nationkey) FROM nation) AS first, 1::BIGINT AS one, 0::BIGINT AS none")
def to_uni_and_back(spark, sf_dir):
    """A flow's first row as a single result; a result, and a null one, as flows."""
    first = create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey").to_uni().map(lambda r: r.n_name)
    return _row(spark, first=first.wait(), one=first.to_multi(spark, "string").df.count(), none=Uni.item(None).to_multi(spark, "int").df.count())


# -- single results


def _count(spark, sf_dir, name: str) -> Uni:
    return Uni(_table(spark, sf_dir, name).count)


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, (SELECT max(c_acctbal) FROM customer) AS best")
def uni_combine_all(spark, sf_dir):
    """Three single results, run side by side, as one row."""
    best = Uni.first_of(_table(spark, sf_dir, "customer").agg(F.max("c_acctbal"))).map(lambda r: r[0])
    n, m, b = join_all([_count(spark, sf_dir, "orders"), _count(spark, sf_dir, "customer"), best]).wait()
    return _row(spark, orders=n, customers=m, best=b)


@query("SELECT count(*) AS first FROM region")
def uni_combine_any(spark, sf_dir):
    """The first of two results; the other waits for longer than the query runs."""
    return _row(spark, first=join_first([Uni.nothing(), _count(spark, sf_dir, "region")]).wait(120, spark))


@query("SELECT (SELECT count(*) FROM nation) AS item, 'a' AS outcome, 2::BIGINT AS failures, 3::BIGINT AS listed")
def uni_join(spark, sf_dir):
    """Joins: the first item although another failed before, the first outcome, all failures together, and all items with two at a time."""
    fails = lambda m: Uni.failure(ValueError(m))
    try:
        outcome = str(join_first([fails("a"), Uni.nothing()]).wait(60, spark))
    except ValueError as e:
        outcome = str(e)
    try:
        failures = len(join_all([fails("a"), Uni.item(1), fails("b")], collect_failures=True).wait())
    except CompositeFlowError as e:
        failures = len(e.causes)
    listed = join_all([Uni.item(i) for i in range(3)], concurrency=2).wait()
    return _row(spark, item=join_first([fails("a"), _count(spark, sf_dir, "nation")], with_item=True).wait(), outcome=outcome, failures=failures, listed=len(listed))


@query("SELECT 1::BIGINT AS item, 2::BIGINT AS deferred, 3::BIGINT AS emitted, 4::BIGINT AS context, (SELECT min(n_nationkey) FROM nation)::BIGINT AS row, 'no' AS failure, 'never' AS nothing")
def uni_creation(spark, sf_dir):
    try:
        failure = str(Uni.failure(lambda: ValueError("no")).wait())
    except ValueError as e:
        failure = str(e)
    try:
        nothing = str(Uni.nothing().wait(0.2, spark))
    except FlowTimeout:
        nothing = "never"
    row = Uni.from_any(create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey")).map(lambda r: int(r.n_nationkey))
    return _row(
        spark, item=Uni.item(1).wait(), deferred=Uni.defer(lambda: Uni.item(2)).wait(), emitted=Uni.emitter(lambda done, fail: (done(3), fail(ValueError("late")))).wait(),
        context=Uni.defer(lambda c: Uni.item(c["n"]), {"n": 4}).wait(), row=row.wait(), failure=failure, nothing=nothing,
    )


@query("SELECT (SELECT count(*) FROM orders) * 2 AS twice, 'x' AS other")
def uni_map(spark, sf_dir):
    n = _count(spark, sf_dir, "orders")
    return _row(spark, twice=n.map(lambda x: x * 2).wait(), other=n.replace_with("x").wait())


@query("SELECT count(*) AS orders FROM orders WHERE o_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer))")
def uni_flat_map(spark, sf_dir):
    """The orders of the richest customer: the second action needs the first one's result."""
    customers, all_orders = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    richest = Uni.first_of(customers.agg(F.min_by("c_custkey", F.struct(-F.col("c_acctbal"), F.col("c_custkey")))))
    return _row(spark, orders=richest.flat_map(lambda r: Uni(all_orders.where(F.col("o_custkey") == r[0]).count)).wait())


@query("SELECT o_orderkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def uni_to_multi(spark, sf_dir):
    """A flow made of a single result."""
    least = Uni.first_of(_table(spark, sf_dir, "orders").agg(F.min("o_custkey"))).map(lambda r: r[0])
    return least.transform_to_multi(spark, lambda k: orders(spark, sf_dir).filter(F.col("o_custkey") == k)).df.select("o_orderkey")


@query("SELECT i AS item FROM range(5) t(i)")
def uni_disjoint(spark, sf_dir):
    return Uni(lambda: [r.id for r in spark.range(5).orderBy("id").collect()]).disjoint(spark, "long").df.select("item")


@query("SELECT -1::BIGINT AS value, (SELECT count(*) FROM nation) AS kept, 'null' AS failure, 10::BIGINT AS mapped")
def uni_if_null(spark, sf_dir):
    """A null result (no nation has a negative key) replaced or failed; others kept or mapped."""
    none = Uni.first_of(_table(spark, sf_dir, "nation").where("n_nationkey < 0"))
    try:
        failure = str(none.if_null(error=ValueError("null")).wait())
    except ValueError as e:
        failure = str(e)
    return _row(spark, value=none.if_null(-1).wait(), kept=_count(spark, sf_dir, "nation").if_null(-1).wait(), failure=failure, mapped=Uni.item(5).if_not_null(lambda x: x * 2).wait())


@query("SELECT (SELECT count(*) FROM region) AS switched, 'on' AS continued, 'ignored' AS failure")
def uni_ignore(spark, sf_dir):
    n = _count(spark, sf_dir, "orders")
    try:
        failure = str(n.and_fail(ValueError("ignored")).wait())
    except ValueError as e:
        failure = str(e)
    return _row(spark, switched=n.and_switch_to(_count(spark, sf_dir, "region")).wait(), continued=n.and_continue_with("on").wait(), failure=failure)


@query("SELECT count(*) AS items, 1::BIGINT AS later, 1::BIGINT AS until FROM region")
def uni_delay(spark, sf_dir):
    """A result held back for a while, and until another is there."""
    before, waited = time.monotonic(), []
    n = _count(spark, sf_dir, "region").delay(0.3).delay_until(lambda x: Uni(lambda: waited.append(x))).wait()
    return _row(spark, items=n, later=int(time.monotonic() - before >= 0.3), until=len(waited))


@query("SELECT 'late' AS item, count(*) AS other FROM region")
def uni_if_no_item(spark, sf_dir):
    """A result that does not come in time, replaced by an item and by another result."""
    slow = Uni.nothing().within(spark, 0.2)
    return _row(spark, item=slow.recover_with("late", on=FlowTimeout).wait(), other=slow.recover_with(_count(spark, sf_dir, "region"), on=FlowTimeout).wait())


@query("SELECT 'boom' AS told, (SELECT count(*) FROM region) AS other, 'not boom' AS changed, 3::BIGINT AS tries")
def uni_on_failure(spark, sf_dir):
    """A failed action recovered, changed, and tried again until it works."""
    fails = Uni(lambda: assert_failed(create.failure(spark, "boom"))).map(lambda m: (_ for _ in ()).throw(ValueError("boom" if "boom" in m else m)))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("again")
        return len(tries)

    changed = fails.map_failure(lambda e: KeyError(f"not {e}")).recover_with(lambda e: e.args[0], on=KeyError)
    return _row(spark, told=fails.recover_with(str).wait(), other=fails.recover_with(_count(spark, sf_dir, "region")).wait(), changed=changed.wait(), tries=Uni(flaky).retry(at_most=5).wait())


@query("SELECT count(*) AS items, 'failed' AS failure FROM region")
def uni_item_or_failure(spark, sf_dir):
    either = lambda u: u.either(lambda x, e: x if e is None else "failed").wait()
    return _row(spark, items=either(_count(spark, sf_dir, "region")), failure=either(Uni.failure(ValueError("x"))))


@query("SELECT 1::BIGINT AS runs, 2::BIGINT AS again, count(*) AS items FROM nation")
def uni_memoize(spark, sf_dir):
    """An action that runs once for two waits, and again when its guard says so."""
    runs, stale, n = [], [], _count(spark, sf_dir, "nation")
    kept = n.invoke(runs.append).memoize(until=lambda: bool(stale))
    items = [kept.wait(), kept.wait()]
    once = len(runs)
    stale.append(1)
    kept.wait()
    return _row(spark, runs=once, again=len(runs), items=items[1])


@query("SELECT 'start,item,end' AS good, 'start,end boom' AS bad, count(*) AS items FROM region")
def uni_hooks(spark, sf_dir):
    good, bad = [], []
    hooked = lambda u, said: u.hooked(on_start=lambda: said.append("start"), on_termination=lambda e: said.append("end" if e is None else f"end {e}"))
    n = hooked(_count(spark, sf_dir, "region").invoke(lambda x: good.append("item")), good).wait()
    hooked(Uni.failure(ValueError("boom")), bad).recover_with(None).wait()
    return _row(spark, good=",".join(good), bad=",".join(bad), items=n)


@query("SELECT '0,1,2' AS most, '0,1' AS until, '0,1,2' AS whilst")
def uni_repeat(spark, sf_dir):
    """A single result evaluated again and again: three times, until it is 2, and as long as it is below 2."""

    def counter() -> Uni:
        n = iter(range(100))
        return Uni(lambda: next(n))

    show = lambda xs: ",".join(map(str, xs))
    return _row(spark, most=show(counter().repeat(at_most=3)), until=show(counter().repeat(until=lambda x: x == 2)), whilst=show(counter().repeat(whilst=lambda x: x < 2)))


@query("SELECT 3::BIGINT AS tries, 'given up' AS failure, '1.0,2.0,4.0,8.0,8.0' AS delays, count(*) AS items FROM nation")
def retry_with_back_off(spark, sf_dir):
    """An action that fails twice, one that fails for good, and the delays between tries."""
    tries = []

    def flaky():
        tries.append(1)
        source = create.failure(spark, "again") if len(tries) < 3 else create.table(spark, f"{sf_dir}/nation.parquet", "n_nationkey")
        return len(source.to_list().wait())

    items = retry(flaky, at_most=5, delays=backoff_delays(0.001, seed=1))
    try:
        failure = str(retry(lambda: (_ for _ in ()).throw(OSError("given up")), at_most=2))
    except OSError as e:
        failure = str(e)
    delays = backoff_delays(1, 8, jitter=0)
    return _row(spark, tries=len(tries), failure=failure, delays=",".join(str(float(next(delays))) for _ in range(5)), items=items)


# -- extension points


@query("SELECT count(*) FILTER (WHERE value > 50 AND event_id % 2 = 0) AS items, 2::BIGINT AS seen FROM events")
def intercept_operators(spark, sf_dir):
    """An interceptor that sees each operator's flow and lets only even ids pass."""
    seen = []

    def even(flow: Flow) -> Flow:
        seen.append(1)
        return flow.filter(F.col("event_id") % 2 == 0)

    flow = events(spark, sf_dir, ())
    remove = intercept(even)
    try:
        n = flow.filter(F.col("value") > 50).map(twice=F.col("value") * 2).df.count()
    finally:
        remove()
    return _row(spark, items=n, seen=len(seen))


@query("SELECT 3::BIGINT AS passed, 2::BIGINT AS caught")
def flow_assertions(spark, sf_dir):
    """Assertions on flows: three that hold, and two that do not."""
    flow = create.items(spark, [1, 2, 3], "int")
    passed = [assert_items(flow, [1, 2, 3]), assert_completed(flow, 3), assert_failed(create.failure(spark, "boom"), "boom")]
    caught = 0
    for check in (lambda: assert_items(flow, [1, 2]), lambda: assert_failed(flow)):
        try:
            check()
        except AssertionError:
            caught += 1
    return _row(spark, passed=len(passed), caught=caught)


@query("SELECT 0::INT AS source, i::BIGINT AS pos, (i * 2)::INT AS item FROM range(1, 4) t(i) UNION ALL SELECT 1, 1, 9")
def stage_publishers(spark, sf_dir):
    """A list of stages that begins with publishers."""
    first = [("of", {"values": [1, 2, 3, 50], "kind": "int"}), ("takeWhile", {"predicate": "item < 10"}), ("map", {"item": "item * 2"})]
    with ThreadPoolExecutor(1) as pool:
        second = [("fromFuture", {"future": pool.submit(lambda: 9), "kind": "int"}), ("filter", {"predicate": "item > 0"})]
        out = compile_stages(None, [("concat", {"first": first, "second": second})], spark)
    return out.df


@query(f"SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY pos) AS items FROM ({POS}) WHERE pos <= 3 GROUP BY 1")
def stage_terminals(spark, sf_dir):
    out = compile_stages(events(spark, sf_dir), [("limit", {"n": 3}), ("onError", {"failed": "value < -1e9", "message": "'too small'"}), ("collect", {"value": "event_id"})])
    return out.withColumn("items", text("items"))
