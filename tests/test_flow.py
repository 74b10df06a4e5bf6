"""Worked examples on literal flows, and every operator against a list model."""

import random
import time

import pytest
from pyspark.sql import functions as F

from runnel.errors import CompositeFlowError, FlowTimeout
from runnel.flow import Flow
from runnel.operators.fold import Gatherer
from runnel.policies import Uni, backoff_delays, join_all, join_first, retry, within
from runnel.plans.stages import compile_stages
from runnel.sources import create, emitters


def values(flow, col="item"):
    df = flow.df if isinstance(flow, Flow) else flow
    order = flow.order if isinstance(flow, Flow) else ["pos"]
    return [r[col] for r in df.orderBy(*order).collect()]


def ints(spark, xs):
    return create.items(spark, xs, "int")


def windows(df):
    return [r["items"] for r in df.orderBy("window_id").collect()]


def test_selections(spark):
    f = ints(spark, [1, 2, 3, 4, 2, 4, 2, 4])
    assert values(f.distinct("item")) == [1, 2, 3, 4]
    r = ints(spark, [1, 2, 3, 4, 4, 2, 2, 4, 1, 1, 2, 4])
    assert values(r.skip_repetitions("item")) == [1, 2, 3, 4, 2, 4, 1, 2, 4]
    assert values(f.first(3)) == [1, 2, 3] and values(f.first(0)) == []
    assert values(f.last(2)) == [2, 4] and values(f.last(0)) == []
    assert values(f.skip_first(6)) == [2, 4] and values(f.skip_last(6)) == [1, 2]
    assert values(f.take_while(F.col("item") < 4)) == [1, 2, 3]
    assert values(f.drop_while(F.col("item") < 4)) == [4, 2, 4, 2, 4]
    with pytest.raises(ValueError):
        f.first(-1)


def test_selection_properties(spark):
    rng = random.Random(3)
    for _ in range(3):
        rows = [(k, p, rng.randint(0, 5)) for k in "ab" for p in range(rng.randint(0, 9))]
        f = Flow(spark.createDataFrame(rows, "k string, pos long, item int"), "pos", "k")
        n = rng.randint(0, 4)
        for name, model in (("first", lambda x: x[:n]), ("last", lambda x: x[max(0, len(x) - n) :]), ("skip_first", lambda x: x[n:]), ("skip_last", lambda x: x[: max(0, len(x) - n)])):
            got = {k: [r.item for r in getattr(f, name)(n).df.where(F.col("k") == k).orderBy("pos").collect()] for k in "ab"}
            assert got == {k: [v for v in model([v for kk, _, v in rows if kk == k])] for k in "ab"}, name


def test_buffers(spark):
    nine = ints(spark, range(1, 10))
    assert windows(nine.buffer("item", 2)) == [[1, 2], [3, 4], [5, 6], [7, 8], [9]]
    assert windows(nine.buffer("item", 2, 3)) == [[1, 2], [4, 5], [7, 8]]
    assert windows(nine.buffer("item", 2, 1)) == [[i, i + 1] for i in range(1, 9)] + [[9]]
    many = windows(ints(spark, range(1, 100)).sliding("item", 6))
    assert len(many) == 95 and many[-1] == [95, 96, 97, 98, 99]
    assert windows(ints(spark, [1, 2]).sliding("item", 6)) == [[1, 2]]
    with pytest.raises(ValueError):
        nine.buffer("item", 0)


def test_time_buffers(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", i) for i, s in enumerate([0, 1, 4, 5, 6, 11, 30])]
    df = spark.createDataFrame(rows, "pos long, t string, item int").withColumn("ts", F.to_timestamp("t"))
    f = Flow(df, "pos", (), "ts")
    ids = [r.buffer_id for r in f.buffer_for(5).orderBy("pos").collect()]
    assert ids == [0, 0, 0, 1, 1, 2, 3]
    assert [r.buffer_id for r in f.buffer_for(5, 2).orderBy("pos").collect()] == [0, 0, 1, 1, 2, 3, 4]
    counts = [r.n for r in f.time_windows("10 seconds").orderBy("window_start").collect()]
    assert counts == [5, 1, 0, 1]


def test_scans(spark):
    nine = ints(spark, range(1, 10))
    running = [1, 3, 6, 10, 15, 21, 28, 36, 45]
    assert values(nine.scan("item", lambda a, b: a + b, "int"), "scan") == running
    assert values(nine.scan_seeded("item", 2, lambda c: F.max(c)), "scan") == [2, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    assert values(nine.scan("item", max, "int", seed=2), "scan") == [2, 2, 2, 3, 4, 5, 6, 7, 8, 9]
    got = [r["item"] for r in nine.gather_scan("item", lambda a, b: a + b, 0, "int").orderBy("seq").collect()]
    assert got == [*running, 45]
    assert [r["item"] for r in create.empty(spark).gather_scan("item", lambda a, b: a + b, 7, "int").collect()] == [7]
    pairs = Gatherer(lambda: [], lambda s, v: [*s, v], lambda s, done: (s[2:], sum(s[:2])) if len(s) >= 2 else None, lambda s: s[0] if s else None)
    assert [r["item"] for r in nine.gather("item", pairs, "int").orderBy("seq").collect()] == [3, 7, 11, 15, 9]
    assert nine.fold("item", F.lit(0), lambda a, x: a + x).first()[0] == 45


def test_statistics(spark):
    f = ints(spark, [1, 2, 3, 4, 2, 5])
    rows = f.running_statistics("item").df.orderBy("pos").collect()
    assert (rows[1].average, rows[1].variance, rows[1].skewness, rows[1].kurtosis) == (1.5, 0.5, 0.0, -2.0)
    assert rows[0].variance != rows[0].variance
    assert [r.median for r in f.running_median("item").orderBy("pos").collect()] == [1, 1.5, 2, 2.5, 2, 2.5]
    letters = create.items(spark, "ebcfge", "string")
    assert values(letters.max_records("item")) == ["e", "f", "g"]
    top = create.items(spark, "abaefbaggez", "string").running_top("item", 3, "string").orderBy("pos").collect()
    assert [r.top for r in top][:4] == [["a"], ["b", "a"], ["e", "b", "a"], ["f", "e", "b"]]
    assert values(f.running_count(), "count") == [1, 2, 3, 4, 5, 6]
    assert values(f.running_totals("item"), "count") == [1, 2, 3, 4, 5, 6]
    assert create.empty(spark).running_median("item").count() == 0


def test_combinations(spark):
    a, b = ints(spark, [1, 2, 3, 4]), ints(spark, range(1, 8))
    assert [(r.item1.item, r.item2.item) for r in a.zip(b).orderBy("pos").collect()] == [(i, i) for i in range(1, 5)]
    later = Flow(b.df.withColumn("at", F.col("pos") + 100), "pos")
    early = Flow(a.df.withColumn("at", F.col("pos")), "pos")
    out = early.latest(later, on="at").orderBy("at").collect()
    assert [(r.item1.item, r.item2.item) for r in out] == [(4, i) for i in range(1, 8)]
    assert values(a.concat(b)) == [1, 2, 3, 4, 1, 2, 3, 4, 5, 6, 7]
    assert sorted(values(a.merge(b))) == sorted([1, 2, 3, 4, 1, 2, 3, 4, 5, 6, 7])
    assert a.concat() is a


def test_collectors(spark):
    people = spark.createDataFrame([(1, "bob", 1), (2, "alice", 2), (3, "rob", 3), (4, "matt", 4), (5, "bob", 5), (6, "rob", 6)], "pos long, name string, id long")
    f = Flow(people, "pos")
    assert f.first(4).collect_map("name", "id").first()[0] == {"bob": 1, "alice": 2, "rob": 3, "matt": 4}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY|Duplicate map key"):
        f.collect_map("name", "id").collect()
    assert f.collect_map("name", "id", merge=F.sum("id")).first()[0]["bob"] == 6
    assert f.collect_multimap("name", "id").first()[0]["rob"] == [3, 6]
    assert f.collect_first("id").first()[0] == 1 and f.collect_last("id").first()[0] == 6
    assert f.collect_list("id").first()[0] == [1, 2, 3, 4, 5, 6]
    empty = create.empty(spark)
    assert empty.collect_first("item").first()[0] is None and empty.collect_list("item").first()[0] == []
    assert [r.name for r in f.group_by("name").groups().orderBy("first_seen").collect()] == ["bob", "alice", "rob", "matt"]


def test_nulls_and_failures(spark):
    f = create.items(spark, [1, None, 3], "int")
    with pytest.raises(Exception, match="gave null"):
        f.map(twice=F.col("item") * 2).df.collect()
    assert values(f.map(on_null="drop", twice=F.col("item") * 2), "twice") == [2, 6]
    assert values(f.map(on_null="keep", twice=F.col("item") * 2), "twice") == [2, None, 6]
    g = ints(spark, [1, 2, 9, 3])
    assert values(g.recover_with_completion(F.col("item") > 5)) == [1, 2]
    assert values(g.recover_with_item(F.col("item") > 5, item=F.lit(0))) == [1, 2, 0]
    assert values(g.recover_with(F.col("item") > 5, ints(spark, [7]))) == [1, 2, 7]
    assert values(g.recover_with(F.col("item") > 50, ints(spark, [7]))) == [1, 2, 9, 3]
    assert values(create.empty(spark).if_empty(ints(spark, [5]))) == [5]
    assert values(g.if_empty(ints(spark, [5]))) == [1, 2, 9, 3]
    with pytest.raises(Exception, match="no such item"):
        create.empty(spark).if_empty_fail().df.collect()
    with pytest.raises(Exception, match="boom"):
        create.failure(spark, "boom").df.collect()
    with pytest.raises(Exception, match="undeclared key"):
        g.split(F.col("item").cast("string"), ["1"])["1"].df.collect()


def test_sources(spark):
    assert values(create.range_(spark, 3, 6)) == [3, 4, 5]
    with pytest.raises(ValueError):
        create.range_(spark, 3, 2)
    assert values(create.generator(spark, 1, lambda s: (s * 2, [s]) if s < 20 else None, "int")) == [1, 2, 4, 8, 16]
    pages = ints(spark, [1, 2, 3, 4])
    assert values(create.repeat_until(pages, F.col("item") == 3)) == [1, 2]
    assert values(create.repeat_whilst(pages, F.col("item") < 3)) == [1, 2, 3]
    assert create.repeat_at_most(pages, 2).df.count() == 8
    assert values(create.replay(pages, 2, ints(spark, [9]))) == [9, 3, 4]
    assert values(emitters.emitter(spark, lambda: iter([4, 5, 6]), "int")) == [4, 5, 6]
    assert values(create.optional(spark, None, "int")) == []


def test_a_long_unfold_is_whole(spark):
    step = lambda s: (s + 1000, range(s, s + 1000)) if s < 1_200_000 else None
    df = create.generator(spark, 0, step, "bigint").df
    assert df.agg(F.count("*"), F.max("pos"), F.max("item"), F.sum(F.col("pos") - F.col("item"))).first() == (1_200_000, 1_200_000, 1_199_999, 1_200_000)
    assert values(create.generator(spark, 0, lambda s: (s + 1, [s, s]), "int", at_most=5)) == [0, 0, 1, 1, 2]


def test_stages(spark):
    f = ints(spark, range(1, 10))
    out = compile_stages(f, [("filter", {"predicate": "item % 2 = 1"}), ("skip", {"n": 1}), ("limit", {"n": 3}), ("collect", {"value": "item"})])
    assert out.first()[0] == [3, 5, 7]
    with pytest.raises(ValueError):
        compile_stages(f, [("collect", {"value": "item"}), ("skip", {"n": 1})])
    with pytest.raises(ValueError):
        compile_stages(f, [("nothing", {})])


def test_policies(spark):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return 7

    assert retry(flaky, at_most=5, delays=backoff_delays(0.001, seed=1)) == 7 and len(calls) == 3
    with pytest.raises(OSError):
        retry(lambda: (_ for _ in ()).throw(OSError("no")), at_most=1)
    delays = backoff_delays(1, 8, jitter=0)
    assert [next(delays) for _ in range(5)] == [1, 2, 4, 8, 8]
    with pytest.raises(FlowTimeout):
        within(spark, 0.5, lambda: time.sleep(2))
    assert Uni.item(None).if_null(5).wait() == 5
    assert Uni.failure(ValueError("x")).recover_with(lambda e: str(e)).wait() == "x"
    once = []
    kept = Uni(lambda: once.append(1) or len(once)).memoize()
    assert kept.wait() == kept.wait() == 1
    assert list(Uni.item(1).repeat(at_most=3)) == [1, 1, 1]
    assert join_all([Uni.item(1), Uni.item(2)]).wait() == [1, 2] and join_all([]).wait() == []
    with pytest.raises(CompositeFlowError):
        join_all([Uni.failure(ValueError("a")), Uni.failure(ValueError("b"))], collect_failures=True).wait()
    assert join_first([Uni.failure(ValueError("a")), Uni.item(3)], with_item=True).wait() == 3


def test_global_positions_span_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 500), i) for i in range(3000)]
    f = Flow(spark.createDataFrame(rows, "a long, b long"), ["a", "b"])
    got = {r.b: r.pos for r in f.with_pos().collect()}
    assert got == {b: i + 1 for i, (a, b) in enumerate(sorted(rows))}


def test_terminals_and_helpers(spark):
    from runnel.functions import scalars

    f = ints(spark, [3, 1, 2])
    seen, ended = [], []
    assert f.subscribe(lambda r: seen.append(r.item), on_completion=lambda: ended.append(1)).wait(60)
    assert seen == [3, 1, 2] and ended == [1]
    failed = []
    assert create.failure(spark, "boom").subscribe(print, on_failure=lambda e: failed.append("boom" in str(e))).wait(60)
    assert failed == [True]
    assert f.to_uni().wait().item == 3 and create.empty(spark).to_uni().wait() is None
    assert values(f.map_python(lambda s: s * 10, "tens", "int", "item"), "tens") == [30, 10, 20]
    t = f.df.select("pos", scalars.map_item(scalars.tuple_of(F.col("item"), F.col("pos")), 1, lambda x: x + 1).alias("t"))
    assert [r.t.item1 for r in t.orderBy("pos").collect()] == [4, 2, 3]
    with pytest.raises(ValueError):
        scalars.tuple_of(F.col("item"))


BIG = (1 << 53) + 1


def test_null_and_long_keys_stay_whole(spark):
    """Each operator that streams, joins or windows groups: one group is that of null, another has a key no double holds."""
    rng = random.Random(5)
    rows = [(k, p, rng.choice([None, rng.randint(0, 9)]), f"2024-01-01 00:00:{rng.randint(0, 59):02d}") for k in (None, BIG, BIG - 1, 3) for p in range(rng.randint(3, 12))]
    df = spark.createDataFrame(rows, "k long, pos long, item int, t string").withColumn("ts", F.to_timestamp("t"))
    f = Flow(df, "pos", "k", "ts")
    keys = [None, BIG, BIG - 1, 3]
    size = {k: sum(r[0] == k for r in rows) for k in keys}
    of = lambda df, k, c, at="pos": [r[c] for r in df.where(F.col("k").eqNullSafe(F.lit(k).cast("long"))).orderBy(at).collect()]
    medians, tops, scans = f.running_median("item"), f.running_top("item", 2, "int"), f.scan("pos", lambda a, b: a + b, "long")
    buffers, slid, zipped = f.buffer_for(1e6, 4), f.sliding("pos", 3), f.zip(f)
    windows_, seconds = f.time_windows("10 seconds"), {k: [r[3] for r in rows if r[0] == k] for k in keys}
    for k in keys:
        items = [r[2] for r in rows if r[0] == k and r[2] is not None]
        assert of(medians, k, "median") == [sorted(items[: i + 1])[i // 2] if i % 2 == 0 else sum(sorted(items[: i + 1])[i // 2 : i // 2 + 2]) / 2 for i in range(len(items))]
        assert of(tops, k, "top")[-1:] == ([sorted(set(items), reverse=True)[:2]] if items else [])
        assert of(scans, k, "scan") == [sum(range(i + 1)) for i in range(size[k])]
        assert of(buffers, k, "buffer_id") == [i // 4 for i in range(size[k])]
        assert of(slid, k, "items", "window_id") == [list(range(i, i + 3)) for i in range(size[k] - 2)] + [list(range(size[k] - 2, size[k]))]
        assert len(of(zipped, k, "pos")) == size[k]
        assert sum(of(windows_, k, "n", "window_start")) == len(seconds[k])
    assert f.time_windows("1 minute", start="2023-12-31 23:59:00").where("n = 0").count() == len(keys)
    clash = Flow(df.withColumnRenamed("k", "__key"), "pos", "__key", "ts")
    assert clash.time_windows("10 seconds").columns == ["__key", "window_start", "n"]


def test_running_values_without_keys(spark):
    rng = random.Random(8)
    rows = [(rng.randint(0, 300), i, rng.choice([None, rng.randint(-50, 50) / 1000])) for i in range(1500)]
    f = Flow(spark.createDataFrame(rows, "a long, b long, v double"), ["a", "b"])
    vs = [v for _, _, v in sorted(rows, key=lambda r: r[:2])]
    known = lambda i: [v for v in vs[: i + 1] if v is not None]
    at = f.running_all(n=("count", F.col("v")), lo=("min", F.col("v")), hi=("max", F.col("v")), now=("last", F.col("v"))).orderBy("a", "b").collect()
    for i in range(0, len(vs), 37):
        seen = known(i)
        assert (at[i].n, at[i].lo, at[i].hi, at[i].now) == (len(seen), min(seen, default=None), max(seen, default=None), seen[-1] if seen else None)
    totals = f.running_totals("v").df.orderBy("a", "b").collect()
    assert abs(totals[-1].sum - sum(known(len(vs)))) < 1e-9 and totals[-1]["count"] == len(vs)
    keyed = Flow(f.df.withColumn("k", F.lit(1)), ["a", "b"], "k").running_statistics("v").df.orderBy("a", "b").collect()
    for x, y in zip(f.running_statistics("v").df.orderBy("a", "b").collect(), keyed):
        for c in ("count", "average", "variance", "stddev", "skewness", "kurtosis", "min", "max"):
            assert x[c] == y[c] or x[c] != x[c] and y[c] != y[c] or abs(x[c] - y[c]) < 1e-6, c
    plan = f.running_sum("v").df._jdf.queryExecution().executedPlan().toString()
    assert "__range" in plan


def test_queues_and_sub_flows(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 0, 0, 0, 10, 25])]
    f = Flow(spark.createDataFrame(rows, "pos long, t string").withColumn("ts", F.to_timestamp("t")), "pos", (), "ts")
    got = lambda **how: [(r.pos, r.tick) for r in f.overflow("t", 10, 1, **how).orderBy("tick", "pos").collect()]
    assert got(capacity=9) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6)]
    assert got(capacity=2, strategy="drop") == [(1, 1), (2, 2), (5, 3), (6, 4)]
    assert got(capacity=2, strategy="latest") == [(3, 1), (4, 2), (5, 3), (6, 4)]
    with pytest.raises(Exception, match="more than 2 items wait"):
        got(capacity=2)
    outer = spark.createDataFrame([(1, None), (2, 7), (3, 8)], "pos long, k long")
    inner = spark.createDataFrame([(None, 1, "a"), (7, 1, "b"), (7, 2, "c"), (None, 2, "d")], "k long, at long, x string")
    subs = lambda *how: [r.sub.x for r in Flow(outer, "pos").sub_flows(Flow(inner, "at"), ["k"], *how)]
    assert subs() == ["a", "d", "b", "c"] and subs("merge", 2) == ["a", "b", "d", "c"]


def test_splits_scan_once_and_deferred_flows(spark):
    f = ints(spark, [1, 2, 3, 4])
    parts = f.split(F.when(F.col("item") > 2, "big").otherwise("small"), ["big", "small"], keep=True)
    assert values(parts["big"]) == [3, 4] and values(parts["small"]) == [1, 2]
    parts.release()
    built = []
    later = create.deferred(lambda: built.append(1) or f)
    assert not built and values(later.first(2)) == [1, 2] and values(later.flow()) == [1, 2, 3, 4] and len(built) == 2
    ends = []
    told = f.on_termination(lambda e, cancelled: ends.append((e is None, cancelled)))
    list(told)
    next(iter(told))
    assert ends == [(True, False), (True, True)]


def test_delays_are_never_shorter_than_the_first():
    delays = backoff_delays(2, 30, jitter=1, seed=3)
    assert all(2 <= next(delays) <= 30 for _ in range(200))


def test_the_losers_of_a_race_are_stopped(spark):
    import threading

    slow = Uni(lambda: spark.range(1, 8, 1, 8).rdd.map(lambda x: time.sleep(60)).count())
    began = time.monotonic()
    assert join_first([slow, Uni(lambda: time.sleep(1) or 5)]).wait() == 5
    until = time.monotonic() + 30
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.monotonic() < until:
        time.sleep(0.1)
    assert time.monotonic() - began < 30 and threading.active_count() < 60
