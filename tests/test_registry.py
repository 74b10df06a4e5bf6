"""Every registered query against its DuckDB SQL on the smallest tables; streams give what batches give."""

import os

import duckdb
import pytest

from runnel.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    cols = [c[0] for c in found.description]
    assert sorted(cols) == sorted(df.columns)
    expected = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got) == expected


def test_buffers_follow_a_greedy_model(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    for name, size in (("buffer_time_anchored", None), ("buffer_size_or_delay", 3)):
        model, key = {}, None
        for e in events:
            if e.user_id != key:
                key, anchor, k = e.user_id, None, -1
            if anchor is None or (e.ts - anchor).total_seconds() >= 86400 or size and len(model[key, k]) >= size:
                anchor, k = e.ts, k + 1
                model[key, k] = []
            model[key, k].append(e.event_id)
        got = {(r.user_id, r.buffer_id): (r.n, r.least) for r in QUERIES[name](spark, SF).collect()}
        assert got == {k: (len(v), min(v)) for k, v in model.items()}


def test_stream_buffers_hold_every_item(spark, tmp_path):
    from runnel.streaming import flows

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    df = flows.events(spark, SF, "events.parquet", schema, "ts", late="1 hour")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = flows.buffers(df, "user_id", "ts", "event_id", 5, 3600.0)
    flows.sink(out, f"{tmp_path}/data", f"{tmp_path}/checkpoint").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/data").collect()
    assert rows and all(r.n == len(r["items"]) <= 5 for r in rows)
    held = [i for r in rows for i in r["items"]]
    assert len(held) == len(set(held))


@pytest.mark.parametrize("block", [8, 60])
def test_parts_of_a_batch_cost_what_they_hold(spark, tmp_path, monkeypatch, block):
    """Parts in order and whole, with null and tied keys, cut from the batch itself or from blocks; numbered once: a part then takes few tasks."""
    from runnel.streaming import flows

    spark.sql("SELECT IF(id % 50 = 0, NULL, id % 40) AS k, id AS at, IF(id % 3 = 0, NULL, CAST(id AS STRING)) AS v FROM range(0, 205, 1, 3)").write.parquet(f"{tmp_path}/in")
    df, tracker, parts, tasks = spark.readStream.schema("k long, at long, v string").parquet(f"{tmp_path}/in"), spark.sparkContext.statusTracker(), [], []
    held = set(spark.sparkContext._jsc.getPersistentRDDs())
    ran = lambda: set(tracker.getJobIdsForGroup(spark.sparkContext.getLocalProperty("spark.jobGroup.id")))

    def take(part, number):
        assert number == 0 and part.columns == ["k", "at", "v"]
        part.count()  # fills the block where this is its first part
        before = ran()
        parts.append([tuple(r) for r in part.collect()])
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        tasks.append(sum(i.numCompletedTasks for j in ran() - before for s in tracker.getJobInfo(j).stageIds if (i := tracker.getStageInfo(s))))

    monkeypatch.setattr(flows, "BLOCK", block, raising=False)
    flows.each_batch(df, take, f"{tmp_path}/checkpoint", cap=10, order=["k", "at"]).awaitTermination()
    expected = sorted(((None if i % 50 == 0 else i % 40, i, None if i % 3 == 0 else str(i)) for i in range(205)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r for p in parts for r in sorted(p, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))] == expected
    assert [len(p) for p in parts] == [10] * 20 + [5]
    assert block == 8 or [r for p in parts for r in p] == expected
    assert all(0 < t <= (4 if block == 8 else 1) for t in tasks), tasks
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= held
