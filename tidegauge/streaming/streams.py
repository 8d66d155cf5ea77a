"""Structured Streaming forms: event-time windows, suppression with state, rules to deliveries.

Streams need ``triggered_at`` as TIMESTAMP. A micro-batch is bounded by the
source's rate limit (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidegauge.functions.common import micros
from tidegauge.operators.fold import output_fields
from tidegauge.operators.machines import NEVER, Batch, Machine

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def windowed_counts(
    events: DataFrame,
    size: str = "5 minutes",
    slide: str | None = None,
    delay: str = "10 minutes",
    start: str | None = None,
) -> DataFrame:
    """Events, failures and pipelines per event-time window; rows later than ``delay`` are dropped.

    Windows are aligned to the epoch (plus ``start``), and there are no empty ones.
    """
    w = F.window("triggered_at", size, slide, start) if slide or start else F.window("triggered_at", size)
    # Two aggregations, one after the other: a count for each window and pipeline, then a sum for each window.
    # Pipelines are told apart by the first, so that no state holds a set of them.
    per_pipeline = (
        events.withWatermark("triggered_at", delay)
        .groupBy(w.alias("w"), "pipeline")
        .agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col("severity") != "info").alias("failure_count"))
    )
    return (
        per_pipeline.groupBy("w")
        .agg(
            F.sum("count").alias("count"), F.sum("failure_count").alias("failure_count"),
            F.count("pipeline").alias("pipeline_count"),
        )
        .select(F.col("w.start").alias("start_at"), F.col("w.end").alias("end_at"), "count", "failure_count", "pipeline_count")
    )


def drop_repeats(events: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """The first event per key within the watermark delay (simple de-duplication)."""
    return events.withWatermark("triggered_at", delay).dropDuplicatesWithinWatermark(list(keys))


class Streak(Machine):
    """Consecutive failures; fires from the ``threshold``-th on."""

    outputs = [("streak", "bigint"), ("fires", "boolean")]

    def __init__(self, threshold: int) -> None:
        self.threshold = threshold

    def start(self) -> list[int]:
        return [0]

    def step(self, state, t, ok):
        state[0] = 0 if ok else state[0] + 1
        return state[0], state[0] >= self.threshold

    def run(self, state, t, ok):
        at = np.arange(len(t))
        last_ok = np.maximum.accumulate(np.where(ok, at, -1 - state[0]))
        streak = at - last_ok
        if len(t):
            state[0] = int(streak[-1])
        return [streak, streak >= self.threshold]


class Throttle(Machine):
    """Runs of events with gaps below the cooldown; state: last time, suppressed so far in the run."""

    outputs = [("suppressed_count", "bigint"), ("throttled", "boolean")]

    def __init__(self, cooldown_us: int, max_suppressed: int | None) -> None:
        self.cooldown, self.cap = cooldown_us, max_suppressed

    def start(self) -> list[int]:
        return []

    def step(self, state, t, ok):
        n = state[1] + 1 if state and t - state[0] < self.cooldown else 0
        state[:] = [t, n]
        return n, n > 0 and (self.cap is None or n - 1 < self.cap)

    def run(self, state, t, ok):
        at = np.arange(len(t))
        far = np.diff(t, prepend=t[:1]) >= self.cooldown
        if len(t):
            far[0] = not state or t[0] - state[0] >= self.cooldown
        # A run goes on from what the state has counted.
        starts = np.maximum.accumulate(np.where(far, at, -1 - (state[1] if state else 0)))
        n = at - starts
        if len(t):
            state[:] = [int(t[-1]), int(n[-1])]
        return [n, (n > 0) & (True if self.cap is None else n - 1 < self.cap)]


class Watermark(Machine):
    """Newest event time so far; an event that does not move it is behind."""

    outputs = [("watermark_us", "bigint"), ("behind", "boolean")]

    def start(self) -> list[int]:
        return []

    def step(self, state, t, ok):
        late = bool(state) and t <= state[0]
        if not late:
            state[:] = [t]
        return state[0], late

    def run(self, state, t, ok):
        before = np.maximum.accumulate(np.concatenate([state or [-NEVER], t]).astype(np.int64))
        if len(t):
            state[:] = [int(before[-1])]
        return [before[1:], t <= before[:-1]]


#: Rows of one result frame.
ROWS_OUT = 10_000
_NULLABLE = {"boolean": "boolean", "bigint": "Int64", "string": "object"}


def _slim(part: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Ids, times, whether there is a time, outcomes (an unknown one is a failure)."""
    timed = part["at_us"].notna().to_numpy()
    return (
        part["event_id"].to_numpy(np.int64),
        part["at_us"].fillna(0).to_numpy(np.int64),
        timed,
        part["ok"].fillna(False).to_numpy(bool),
    )


class _MachineProcessor(StatefulProcessor):
    """Runs a machine per key; the state survives between micro-batches, with an optional time to live."""

    def __init__(self, machine: Machine, ttl_ms: int | None) -> None:
        self.machine, self.ttl_ms = machine, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "s array<bigint>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of a row only id, time and outcome are held, 17 bytes; the source bounds a micro-batch.
        parts = [_slim(part) for part in rows]
        ids, t, timed, ok = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, t, timed))
        ids, t, timed, ok = ids[order], t[order], timed[order], ok[order]
        newest, *state = [int(x) for x in self.state.get()[0]] if self.state.exists() else [-NEVER, *self.machine.start()]
        results = [pd.array([None] * len(ids), _NULLABLE[kind]) for _, kind in self.machine.outputs]
        for column, values in zip(results, self.machine.run(state, t[timed], ok[timed])):
            column[timed] = values
        late = timed & (t < newest)
        if timed.any():
            self.state.update(([max(newest, int(t[-1])), *state],))
        out = pd.DataFrame({"event_id": ids, **dict(zip([n for n, _ in self.machine.outputs], results)), "late": late})
        for a in range(0, len(out), ROWS_OUT):
            yield out.iloc[a : a + ROWS_OUT]

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The state store that ``transformWithState`` needs, for streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, "")
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        if before:
            spark.conf.set(name, before)
        else:
            spark.conf.unset(name)


def suppress(
    events: DataFrame,
    machine: Machine,
    keys: Sequence[str] = ("pipeline", "check_name"),
    ttl_seconds: float | None = None,
) -> DataFrame:
    """Event ids with the outputs of a per-key machine (cooldown, quota, breaker, batch, ...).

    ``ttl_seconds`` forgets idle keys; such a stream runs on the wall clock and
    does not end by itself. Within a micro-batch a key's rows are taken in (time, id) order; across
    micro-batches in the order of arrival, and ``late`` marks rows older than what their key
    had seen before: they meet the state as it is. Rows without a time have null results.
    """
    late = T.StructField("late", T.BooleanType())
    out = T.StructType([T.StructField("event_id", T.LongType()), *output_fields(machine), late])
    slim = events.select(*keys, "event_id", micros("triggered_at").alias("at_us"), F.col("passed").alias("ok"))
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)
    return slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_MachineProcessor(machine, ttl),
        outputStructType=out,
        outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime",
    )


def _packed(t: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> bytes:
    return np.concatenate([t, ids, ok.astype(np.int64)]).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, ids, ok = np.frombuffer(raw, np.int64).reshape(3, -1)
    return t, ids, ok.astype(bool)


class _OrderedProcessor(StatefulProcessor):
    """Holds rows by time slot until the watermark has passed the slot, then runs the machine over them in order.

    A slot is a value of a map state, so that a key's rows are read slot by slot; each slot
    has a timer at its end.
    """

    def __init__(self, machine: Machine, slot_us: int) -> None:
        self.machine, self.slot = machine, slot_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "s array<bigint>")
        self.held = handle.getMapState("held", "slot bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            ids, t, _, ok = _slim(part)
            slots = t // self.slot
            for slot in np.unique(slots).tolist():
                own = slots == slot
                new = (t[own], ids[own], ok[own])
                if self.held.containsKey((slot,)):
                    old = _unpacked(self.held.getValue((slot,))[0])
                    new = tuple(np.concatenate(x) for x in zip(old, new))
                self.held.updateValue((slot,), (_packed(*new),))
                self.handle.registerTimer(-(-(slot + 1) * self.slot // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.slot
        ready = sorted(k[0] for k in self.held.keys() if k[0] < passed)
        if not ready:
            return
        state = [int(x) for x in self.state.get()[0]] if self.state.exists() else self.machine.start()
        for slot in ready:
            t, ids, ok = _unpacked(self.held.getValue((slot,))[0])
            self.held.removeKey((slot,))
            order = np.lexsort((ids, t))
            columns = self.machine.run(state, t[order], ok[order])
            out = pd.DataFrame({"event_id": ids[order], **dict(zip([n for n, _ in self.machine.outputs], columns))})
            for a in range(0, len(out), ROWS_OUT):
                yield out.iloc[a : a + ROWS_OUT]
        self.state.update((state,))

    def close(self) -> None:
        pass


def suppress_in_order(
    events: DataFrame,
    machine: Machine,
    keys: Sequence[str] = ("pipeline", "check_name"),
    delay: str = "10 minutes",
    slot_seconds: float = 60,
) -> DataFrame:
    """Event ids with the outputs of a per-key machine, in the order of event time whatever the order of arrival.

    Rows wait in slots of ``slot_seconds`` until the watermark, ``delay`` behind the newest
    time, has passed the end of their slot. Rows later than that are dropped, as Spark does
    with late rows; rows without a time come at once, with null results.
    """
    out = T.StructType([T.StructField("event_id", T.LongType()), *output_fields(machine)])
    ok = F.col("passed").alias("ok")
    timed = events.filter("triggered_at is not null").withWatermark("triggered_at", delay)
    slim = timed.select(*keys, "event_id", "triggered_at", micros("triggered_at").alias("at_us"), ok)
    found = slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_OrderedProcessor(machine, int(slot_seconds * 1_000_000)),
        outputStructType=out, outputMode="Append", timeMode="EventTime",
    )
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in out.fields[1:]]
    return found.unionByName(events.filter("triggered_at is null").select("event_id", *nothing))


class _LatestProcessor(StatefulProcessor):
    """Keeps the newest result per key for ``ttl`` and emits it when it changes."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "t bigint, id bigint", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        newest, row = (self.state.get() if self.state.exists() else None), None
        newest = tuple(newest) if newest else None
        for part in rows:
            last = part.sort_values(["at_us", "event_id"]).iloc[-1]
            mark = (int(last["at_us"]), int(last["event_id"]))
            if newest is None or mark > newest:
                newest, row = mark, last
        if row is not None:
            self.state.update(newest)
            yield pd.DataFrame(
                {"pipeline": [key[0]], "check_name": [key[1]], "event_id": [newest[1]], "status": [row["status"]], "at_us": [newest[0]]}
            )

    def close(self) -> None:
        pass


def latest_results(events: DataFrame, ttl_seconds: float | None = None) -> DataFrame:
    """The newest result per (pipeline, check), forgotten after its time to live.

    Results without a time are never the newest.

    A stream with a time to live runs on the wall clock and does not end by
    itself, so leave it out for a run over all available input.
    """
    ttl = None if ttl_seconds is None else int(ttl_seconds * 1000)
    slim = events.filter("triggered_at is not null").select(
        "pipeline", "check_name", "event_id", micros("triggered_at").alias("at_us"), "status")
    return slim.groupBy("pipeline", "check_name").transformWithStateInPandas(
        statefulProcessor=_LatestProcessor(ttl),
        outputStructType="pipeline string, check_name string, event_id bigint, status string, at_us bigint",
        outputMode="Append",
        timeMode="None" if ttl is None else "ProcessingTime",
    )


class _BufferProcessor(StatefulProcessor):
    """Open buffer per key: number, size, first and last time. A timer closes it when it is too old."""

    def __init__(self, max_size: int, max_age_us: int, keys: Sequence[str]) -> None:
        self.machine, self.keys = Batch(max_size, max_age_us), list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buffer", "number bigint, size bigint, first bigint, last bigint")

    def _frame(self, key, flushed: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(flushed, columns=["batch_no", "size", "opened_us", "last_us", "reason"])
        for i, k in enumerate(self.keys):
            out.insert(i, k, key[i])
        return out

    def handleInputRows(self, key, rows, timerValues):
        number, size, first, last = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        # Of a row its time is held, 8 bytes; the source bounds a micro-batch.
        t = np.sort(np.concatenate([part["at_us"].to_numpy(np.int64) for part in rows]))
        state = [number, size, first]
        ends = self.machine.closers(state, t)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)[: len(ends)]
        sizes, opened = ends - starts + 1, t[starts]
        if len(ends) and size:
            sizes[0], opened[0] = sizes[0] + size, first
        self.state.update((state[0], state[1], state[2], int(t[-1]) if len(t) else last))
        if state[1]:
            self.handle.registerTimer((state[2] + self.machine.max_age + 999) // 1000)
        reason = np.where(sizes >= self.machine.max_size, "size", "age")
        columns = (number + np.arange(len(ends)), sizes, opened, t[ends], reason)
        yield self._frame(key, list(zip(*(c.tolist() for c in columns))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        number, size, first, last = self.state.get()
        if size and expiredTimerInfo.getExpiryTimeInMs() * 1000 >= first + self.machine.max_age:
            self.state.update((number + 1, 0, 0, 0))
            yield self._frame(key, [(number, size, first, last, "age")])

    def close(self) -> None:
        pass


def buffers(
    events: DataFrame,
    max_size: int = 50,
    max_age_seconds: float = 300,
    delay: str = "10 minutes",
    keys: Sequence[str] = ("pipeline",),
) -> DataFrame:
    """Flushed buffers: by size, by an event that comes when the buffer is too old, or by the watermark.

    Events without a time are in no buffer.
    """
    out = T.StructType(
        [
            *[events.schema[k] for k in keys],
            *[T.StructField(n, T.LongType()) for n in ("batch_no", "size", "opened_us", "last_us")],
            T.StructField("reason", T.StringType()),
        ]
    )
    timed = events.filter("triggered_at is not null").withWatermark("triggered_at", delay)
    slim = timed.select(*keys, "triggered_at", micros("triggered_at").alias("at_us"))
    return slim.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_BufferProcessor(max_size, int(max_age_seconds * 1_000_000), keys),
        outputStructType=out,
        outputMode="Append",
        timeMode="EventTime",
    )


def deliver(
    events: DataFrame, to_records: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, available_now: bool = True
):
    """Run batch operators on every micro-batch and write the records.

    Each micro-batch replaces its own folder, so a repeated one leaves no
    duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        to_records(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def to_table(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Append a stream to a parquet table."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# Processors are pickled by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
