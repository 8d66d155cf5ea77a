"""A key with a large share of the rows is cut into chunks; results must not change."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.operators import fold as K
from tidegauge.operators import ordered as O
from tidegauge.operators.spread import Spread

KEYS = ["pipeline", "check_name"]
ORDER = ["triggered_at", "event_id"]
T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    """Half of the rows belong to one (pipeline, check); many times are equal; one key is null."""
    rng = random.Random(3)
    rows, t = [], T0
    for i in range(3000):
        t += timedelta(seconds=rng.choice([0, 1, 5, 30, 400]))
        pipeline, check = ("hot", "c") if rng.random() < 0.5 else (rng.choice(["a", "b", None]), rng.choice("cd"))
        rows.append((i, pipeline, check, rng.random() < 0.6, float(rng.randint(0, 50)), t))
    rng.shuffle(rows)
    schema = "event_id bigint, pipeline string, check_name string, passed boolean, value double, triggered_at timestamp_ntz"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


def same(a, b):
    key = lambda r: str(tuple(r))
    left, right = sorted(a.collect(), key=key), sorted(b.select(*a.columns).collect(), key=key)
    assert left == right


CASES = {
    "debounce": lambda e, m: O.debounce(e, 2, max_rows=m),
    "throttle": lambda e, m: O.throttle(e, 1, 3, max_rows=m),
    "recurrence": lambda e, m: O.recurrence(e, max_rows=m),
    "buffer_by_size": lambda e, m: O.buffer_by_size(e, 7, max_rows=m),
    "watermark": lambda e, m: O.watermark_advance(e, ["event_id"], "triggered_at", "2024-03-01 00:00:00", max_rows=m),
    "diff": lambda e, m: O.diff_previous(e, KEYS, ORDER, max_rows=m),
    "dedupe": lambda e, m: K.dedupe(e, 10, max_rows=m),
    "cooldown": lambda e, m: K.cooldown(e, 1000, max_rows=m),
    "quota": lambda e, m: K.quota(e, 4, 10, max_rows=m),
    "backoff": lambda e, m: K.backoff(e, 60, 2, 3600, 6, max_rows=m),
    "breaker": lambda e, m: K.circuit_breaker(e, 3, 300, max_rows=m),
    "batch": lambda e, m: K.batch(e, 6, 200, max_rows=m),
    "compact": lambda e, m: K.compact(e, 120, 900, order=ORDER, max_rows=m),
    "rolling": lambda e, m: A.rolling_anomalies(
        e.withColumn("metric", F.col("check_name")), 9, 1.0, ORDER, max_rows=m
    ),
    "profile": lambda e, m: A.profile_report(
        e.select(*KEYS, F.col("value").alias("duration_ms")), exact_rows=m or A.EXACT_ROWS,
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_chunks_change_nothing(events, name):
    plain, cut = CASES[name](events, None), CASES[name](events, 120)
    assert plain.count() > 0
    same(plain, cut)


@pytest.mark.parametrize("name", ["dedupe", "cooldown", "backoff", "breaker", "batch", "compact"])
def test_tables_joined_by_doubling_change_nothing(events, name, monkeypatch):
    """Chunks whose tables are too large for one task are put together by joins."""
    monkeypatch.setattr(K, "RELAY_BYTES", 0)
    same(CASES[name](events, None), CASES[name](events, 60))


@pytest.mark.parametrize("limit,minutes", [(1, 10), (4, 10), (40, 3000), (2, 100_000)])
def test_quota_from_guesses(events, limit, minutes):
    """Short windows that forget at once, and a window that no chunk outlasts."""
    same(K.quota(events, limit, minutes), K.quota(events, limit, minutes, max_rows=60))


def test_no_task_reads_a_whole_key(spark):
    """Of a frequent key, what a chunk passes on is far shorter than its events."""
    from tidegauge.operators.machines import Breaker, tables

    rows = spark.range(40_000).select(
        F.lit("hot").alias("pipeline"), F.col("id").alias("event_id"), (F.col("id") % 7 > 0).alias("_ok"),
        F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("triggered_at"),
        (F.col("id") * 1_000_000).alias("_t"))
    s = Spread(rows, ["pipeline"], ORDER, 5_000)
    fields = K._fields(s, ["pipeline"], _table=K._RAW)
    found = K._in_order(s, ["pipeline"], s.hot_rows).mapInArrow(tables(Breaker(5, 60_000_000), ["pipeline"]), fields)
    sizes = [r.n for r in found.select(F.octet_length("_table").alias("n")).collect()]
    assert len(sizes) == s.chunks >= 8 and max(sizes) < 10_000


def test_hot_key_is_cut(events):
    s = Spread(events, KEYS, ORDER, 120)
    assert s.hot
    sizes = {r[0]: r[1] for r in s.df.filter("pipeline = 'hot'").groupBy("_chunk").count().collect()}
    assert 0 not in sizes and len(sizes) > 5 and max(sizes.values()) <= 500
    assert not Spread(events, KEYS, ORDER, 10_000).hot


def sequential(machine, rows):
    """Fold plain rows one by one."""
    state, out = {}, {}
    for r in sorted(rows, key=lambda r: (r.triggered_at, r.event_id)):
        key = (r.pipeline, r.check_name)
        s = state.setdefault(key, machine.start())
        us = round((r.triggered_at - datetime(1970, 1, 1)) / timedelta(microseconds=1))
        out[r.event_id] = machine.step(s, us, r.passed)
    return out


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("arrow_rows", [7, 10_000])
def test_fold_does_not_depend_on_layout(spark, events, parts, arrow_rows):
    machine = K.Cooldown(600_000_000)
    want = sequential(machine, events.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for limit in (None, 200):
            got = K.fold(events, machine, max_rows=limit).collect()
            assert {r.event_id: (r.fired, r.last_fired_us) for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.shuffle.partitions", 8)


@pytest.mark.parametrize("exact_rows", [1, 50, 100_000])
def test_percentiles_by_selection(spark, exact_rows):
    """Outliers, ties, values that are close, signs, nulls and what is no finite number; against sorting."""
    rng = random.Random(9)
    series = {
        "wide": [10 ** rng.uniform(-8, 300) * rng.choice([-1, 1]) for _ in range(500)],
        "close": [1e9 + i * 1e-7 for i in range(300)],
        "tied": [float(rng.randint(0, 3)) for _ in range(400)],
        "odd": [None] * 5 + [float("-inf")] * 3 + [1.0, 2.0] + [float("inf")] * 4 + [float("nan")] * 9,
        "nulls": [None] * 40 + [1.0], "low": [float("-inf")] * 39 + [3.0], "one": [7.5], None: [0.0, -0.0, 4.0],
        "high": [1.0] * 10 + [float("inf")] * 30,
    }
    rows = [(p, "c", d) for p, ds in series.items() for d in ds]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pipeline string, check_name string, duration_ms double").repartition(4)
    got = {r.pipeline: r for r in A.profile_report(df, exact_rows=exact_rows).collect()}
    order = lambda d: (0, 0.0) if d is None else (2, 0.0) if d != d else (1, d)
    for p, ds in series.items():
        want = sorted(ds, key=order)[max(1, int(len(ds) * 0.95)) - 1]
        assert got[p]["count"] == len(ds)
        assert got[p].p95_ms == want or (want != want and got[p].p95_ms != got[p].p95_ms), p


def test_percentiles_sort_no_samples(spark):
    df = spark.range(5_000).select(F.lit("hot").alias("pipeline"), F.lit("c").alias("check_name"), F.rand(1).alias("duration_ms"))
    plan = A.profile_report(df, exact_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
