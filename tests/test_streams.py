"""State of streams across micro-batches: late rows, rows without a time, time to live."""

import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder
from tidegauge.operators import fold as K
from tidegauge.operators.machines import Batch, Breaker, Cooldown, Quota
from tidegauge.sources import testdata
from tidegauge.streaming import streams as X

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, pipeline string, check_name string, passed boolean, status string, triggered_at timestamp"
MINUTE = 60_000_000


def put(spark, path, *rows):
    data = [(i, p, "c", True, s, None if m is None else T0 + timedelta(minutes=m)) for i, p, m, s in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


def seen(stream, rows):
    """Wait until so many rows were read; a stream with a time to live is never out of work."""
    for _ in range(300):
        if sum(p["numInputRows"] for p in stream.recentProgress) >= rows:
            return
        assert stream.isActive, stream.exception()
        time.sleep(0.2)
    raise AssertionError("the stream is too slow")


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_suppress_over_micro_batches(spark):
    path = work_folder(spark, "stream-test")
    put(spark, path, (1, "p", 0, "a"), (2, "p", 10, "a"), (3, "q", 5, "a"))
    put(spark, path, (4, "p", 20, "a"), (5, "p", None, "a"), (6, "q", 60, "a"))
    put(spark, path, (7, "p", 40, "a"), (8, "q", 50, "a"), (9, "q", 91, "a"))
    with X.rocksdb_state(spark):
        rows = X.suppress(source(spark, path), Cooldown(30 * MINUTE))
        X.to_table(rows, path + "-out", path + "-progress").awaitTermination()
    got = {r.event_id: (r.fired, r.late) for r in spark.read.schema(rows.schema).parquet(path + "-out").collect()}
    assert got == {
        1: (True, False), 2: (False, False), 3: (True, False), 4: (False, False), 5: (None, False), 6: (True, False),
        7: (True, False), 8: (False, True), 9: (True, False),
    }


@pytest.mark.parametrize("ttl", [1.0, None])
def test_time_to_live(spark, ttl):
    """With a time to live, a key that was idle for longer is new again."""
    path = work_folder(spark, "ttl-test")
    put(spark, path, (1, "p", 0, "a"))
    with X.rocksdb_state(spark):
        rows = X.suppress(source(spark, path), Cooldown(30 * MINUTE), ttl_seconds=ttl)
        stream = X.to_table(rows, path + "-out", path + "-progress", available_now=False)
        try:
            seen(stream, 1)
            time.sleep(2.5)
            put(spark, path, (2, "p", 1, "a"))
            seen(stream, 2)
        finally:
            stream.stop()
    got = {r.event_id: r.fired for r in spark.read.schema(rows.schema).parquet(path + "-out").collect()}
    assert got == {1: True, 2: ttl is not None}


def test_latest_results_with_time_to_live(spark):
    path = work_folder(spark, "latest-test")
    put(spark, path, (1, "p", 10, "new"))
    with X.rocksdb_state(spark):
        rows = X.latest_results(source(spark, path), ttl_seconds=1.0)
        stream = X.to_table(rows, path + "-out", path + "-progress", available_now=False)
        try:
            seen(stream, 1)
            time.sleep(2.5)
            put(spark, path, (2, "p", 0, "older"))
            seen(stream, 2)
        finally:
            stream.stop()
    got = [(r.event_id, r.status) for r in spark.read.schema(rows.schema).parquet(path + "-out").orderBy("event_id").collect()]
    assert got == [(1, "new"), (2, "older")]


@pytest.mark.parametrize("times", ["some", "none", "no rows"])
def test_event_stream_keeps_rows_without_a_time(spark, folder, tmp_path, times):
    events = spark.read.parquet(f"{folder}/events.parquet").orderBy("event_id").limit(0 if times == "no rows" else 40)
    lost = F.col("ts").isNull() | (F.lit(True) if times == "none" else F.col("event_id") % 4 == 0)
    events.withColumn("ts", F.when(~lost, F.col("ts"))).write.parquet(f"{tmp_path}/events.parquet")
    stream = testdata.alert_event_stream(spark, str(tmp_path))
    out = work_folder(spark, "stream-null")
    X.to_table(stream, out, out + "-progress").awaitTermination()
    got = {r.event_id for r in spark.read.schema(stream.schema).parquet(out).collect()}
    assert got == {r.event_id for r in events.collect()}


# Order of event time


DISORDERED = {
    "dedupe": (Cooldown(30 * MINUTE), ["pipeline", "check_name"], lambda e: K.dedupe(e, 30)),
    "quota": (Quota(3, 60 * MINUTE), ["pipeline"], lambda e: K.quota(e, 3, 60)),
    "breaker": (Breaker(2, 20 * MINUTE), ["pipeline"], lambda e: K.circuit_breaker(e, 2, 20 * 60)),
    "batch": (Batch(4, 50 * MINUTE), ["pipeline"], lambda e: K.batch(e, 4, 50 * 60)),
}


def disordered(rng, n=120, batches=6, off=25):
    """Events over some hours, dealt to micro-batches by a time that is up to ``off`` minutes away from theirs."""
    rows = [(i, rng.choice("pq"), rng.random() < 0.5, rng.uniform(0, 600)) for i in range(n)]
    rows += [(n, "p", True, 900.0), (n + 1, "q", True, None)]
    turn = lambda m: 0 if m is None else min(max(m + rng.uniform(-off, off), 0), 899) if m < 900 else 899
    parts = [[] for _ in range(batches)]
    for r in sorted(rows, key=lambda r: turn(r[3])):
        parts[int(turn(r[3]) * batches // 900) if r[3] != 900 else batches - 1].append(r)
    return rows, [p for p in parts if p]


def put_events(spark, path, rows):
    data = [(i, p, "c", ok, "s", None if m is None else T0 + timedelta(minutes=m)) for i, p, ok, m in rows]
    random.Random(0).shuffle(data)
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


@pytest.mark.parametrize("name", DISORDERED)
def test_disordered_micro_batches_give_the_batch_result(spark, name):
    machine, keys, batch = DISORDERED[name]
    rows, parts = disordered(random.Random(7))
    path = work_folder(spark, "disorder-test")
    for part in parts:
        put_events(spark, path, part)
    with X.rocksdb_state(spark):
        out = X.suppress_in_order(source(spark, path), machine, keys, "90 minutes", 600)
        X.to_table(out, path + "-out", path + "-progress").awaitTermination()
    got = spark.read.schema(out.schema).parquet(path + "-out")
    events = spark.read.schema(SCHEMA).parquet(path).withColumn("triggered_at", F.col("triggered_at").cast("timestamp_ntz"))
    want = batch(events).select(*out.columns)
    untimed = [len(rows) - 1]
    released = [i for i, _, _, m in rows if m is not None and m < 810] + untimed
    assert len(released) == len(rows) - 1
    key = lambda r: r.event_id
    assert sorted(got.collect(), key=key) == sorted(want.filter(F.col("event_id").isin(released)).collect(), key=key)
    assert {tuple(r)[1:] for r in got.filter(F.col("event_id").isin(untimed)).collect()} == {(None,) * (len(out.columns) - 1)}


def test_a_stream_goes_on_from_its_checkpoint(spark):
    """Stopped in the middle of its input and started anew: held rows, state and results are those of one run."""
    machine, keys, batch = DISORDERED["dedupe"]
    rows, parts = disordered(random.Random(8))
    path = work_folder(spark, "restart-test")
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for part in half:
            put_events(spark, path, part)
        with X.rocksdb_state(spark):
            out = X.suppress_in_order(source(spark, path), machine, keys, "90 minutes", 600)
            X.to_table(out, path + "-out", path + "-progress").awaitTermination()
    got = spark.read.schema(out.schema).parquet(path + "-out")
    events = spark.read.schema(SCHEMA).parquet(path).withColumn("triggered_at", F.col("triggered_at").cast("timestamp_ntz"))
    want = {r.event_id: r.fired for r in batch(events).collect()}
    seen_ = [(r.event_id, r.fired) for r in got.collect()]
    assert len(seen_) == len(rows) - 1 and all(want[i] == fired for i, fired in seen_)


def test_latest_and_buffers_without_times(spark):
    """Rows without a time are never the newest and in no buffer."""
    path = work_folder(spark, "untimed-test")
    put(spark, path, (1, "p", 10, "old"), (2, "p", None, "lost"), (3, "q", None, "lost"), (4, "p", 0, "older"))
    put(spark, path, (5, "p", None, "lost"), (6, "p", 20, "new"), (7, "p", 900, "late"))
    with X.rocksdb_state(spark):
        latest = X.latest_results(source(spark, path))
        X.to_table(latest, path + "-latest", path + "-p1").awaitTermination()
        full = X.buffers(source(spark, path), 2, 3600)
        X.to_table(full, path + "-full", path + "-p2").awaitTermination()
    got = [(r.event_id, r.status) for r in spark.read.schema(latest.schema).parquet(path + "-latest").orderBy("at_us").collect()]
    assert got == [(1, "old"), (7, "late")]
    got = [(r.pipeline, r.batch_no, r["size"], r.reason) for r in spark.read.schema(full.schema).parquet(path + "-full").collect()]
    assert sorted(got) == [("p", 0, 2, "size"), ("p", 1, 2, "size")]


@pytest.mark.parametrize("make", [lambda: X.Streak(3), lambda: X.Throttle(20, 2), lambda: X.Throttle(20, None), X.Watermark])
def test_runs_of_stream_machines_equal_steps(make):
    rng = random.Random(6)
    for _ in range(300):
        m = make()
        t = np.cumsum([rng.choice([0, 1, 5, 20, 60]) for _ in range(rng.randint(0, 40))]).astype(np.int64)
        ok = np.array([rng.random() < 0.3 for _ in t], dtype=bool)
        cut = rng.randint(0, len(t))
        state = m.start()
        for a, b in zip(t[:cut].tolist(), ok[:cut].tolist()):
            m.step(state, a, b)
        other = list(state)
        want = [m.step(state, a, b) for a, b in zip(t[cut:].tolist(), ok[cut:].tolist())]
        got = m.run(other, t[cut:], ok[cut:])
        assert [tuple(r) for r in zip(*(c.tolist() for c in got))] == want and other == state
