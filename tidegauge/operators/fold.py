"""Greedy per-key state: operators whose next state depends on which earlier events *fired*.

``lag`` cannot express these, so each key's rows are sorted and folded in
Arrow batches with a state of constant size. A key with more than ``max_rows``
rows is cut into chunks (see :mod:`spread`) that are folded in parallel. The
state each chunk starts from is found first, and no task reads a whole key for it:

- What follows a change of state depends on its place alone, but for quotas. Each chunk
  becomes a short table of exit states by the place of the first change, found by doubling
  pointers from event to event, and the tables of a key are put together: up to
  ``RELAY_BYTES`` one after the other, which is a look-up each; beyond that by joins of each
  chunk's table with the one before it, twice as far in every round.
- A quota remembers several events. Every chunk is folded from a guess, the state in which
  the chunk before it ended when last folded, and again until no guess changes. Old events
  leave the window, so two rounds mostly do; after as many rounds as there are chunks it is
  exact in any case.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.common import micros, null_safe_on, plus_seconds, require, written
from tidegauge.operators.machines import (
    Backoff,
    Batch,
    Breaker,
    Compact,
    Cooldown,
    Machine,
    Quota,
    Tabled,
    chunk_exits,
    joiner,
    relay,
    runner,
    tables,
)
from tidegauge.operators.ordered import EVENT_KEYS, EVENT_ORDER
from tidegauge.operators.spread import CARRIED_VALUES, MAX_ROWS, Spread

# Tables of chunks that are read one after the other, in one task.
RELAY_BYTES = 64_000_000

_TYPES = {"boolean": T.BooleanType(), "bigint": T.LongType(), "string": T.StringType()}


def output_fields(machine: Machine) -> list[T.StructField]:
    return [T.StructField(n, _TYPES[t]) for n, t in machine.outputs]


_RAW = T.BinaryType()


def _fields(spread: Spread, keys: list[str], **others: T.DataType) -> T.StructType:
    own = [spread.hot_rows.schema[k] for k in keys] + [T.StructField("_chunk", T.IntegerType())]
    return T.StructType([*own, *[T.StructField(n, t) for n, t in others.items()]])


def _in_order(spread: Spread, keys: list[str], rows: DataFrame, *others: str) -> DataFrame:
    """The rows of each chunk in order; a chunk is within one partition."""
    slim = rows.select(*keys, "_chunk", *spread.order, "_t", "_ok", *others)
    return slim.sortWithinPartitions(*keys, "_chunk", *spread.order).select(*keys, "_chunk", "_t", "_ok", *others)


def _by_chunk(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_chunk")


def _tabled_entries(spread: Spread, machine: Tabled, keys: list[str], relay_bytes: int) -> DataFrame:
    """The state in which each chunk of a frequent key starts, from the chunks' tables."""
    rows = _in_order(spread, keys, spread.hot_rows)
    found = written(rows.mapInArrow(tables(machine, keys), _fields(spread, keys, _table=_RAW)), "chunk-tables")
    entry = _fields(spread, keys, _entry=_RAW)
    if (found.agg(F.sum(F.octet_length("_table"))).first()[0] or 0) <= relay_bytes:
        # A key's tables, of bounded size.
        in_order = found.repartition(*keys).sortWithinPartitions(*keys, "_chunk")
        return in_order.mapInArrow(relay(machine, keys), entry)
    schema = _fields(spread, keys, _nth=T.LongType(), _state=_RAW, _table=_RAW)
    start = machine.columns(machine.start()).tobytes()
    nothing = F.lit(None).cast(_RAW)
    nth = F.row_number().over(_by_chunk(keys)).cast("long")
    found = found.select(*keys, "_chunk", nth.alias("_nth"), "_table")
    first = found.select("*", F.when(F.col("_nth") == 1, F.lit(start)).alias("_before_state"), nothing.alias("_before"))
    found = written(first.mapInArrow(joiner(machine), schema), "chunk-states")
    reach, most = 1, found.agg(F.max("_nth")).first()[0] or 0
    while reach < most:
        # The table of a chunk now covers ``reach`` chunks, or is a state as it covers all up to it.
        named = [F.col(k).alias(f"_b_{k}") for k in keys]
        before = found.select(
            *named, (F.col("_nth") + reach).alias("_b_nth"), F.col("_state").alias("_before_state"),
            F.col("_table").alias("_before"))
        same = F.col("_nth") == F.col("_b_nth")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        met = found.where(F.col("_state").isNull()).drop("_state").join(before, same)
        met = met.drop("_b_nth", *[f"_b_{k}" for k in keys]).mapInArrow(joiner(machine), schema)
        found = written(found.where(F.col("_state").isNotNull()).unionByName(met), "chunk-states")
        reach *= 2
    state = F.lag("_state").over(_by_chunk(keys))
    return found.select(*keys, "_chunk", F.substring(state, 1, 8 * machine.width).alias("_entry"))


def _guessed_entries(spread: Spread, machine: Machine, keys: list[str]) -> DataFrame:
    """The state in which each chunk of a frequent key starts, by folding from guesses until none changes."""
    schema = _fields(spread, keys, _exit=_RAW)

    def folded(rows: DataFrame) -> DataFrame:
        return _in_order(spread, keys, rows, "_entry").mapInArrow(chunk_exits(machine, keys), schema)

    exits = written(folded(spread.hot_rows.withColumn("_entry", F.lit(None).cast(_RAW))), "chunk-exits")
    entries = written(exits.select(*keys, "_chunk", F.lit(None).cast(_RAW).alias("_entry")), "chunk-entries")
    while True:
        guess = exits.select(*keys, "_chunk", F.lag("_exit").over(_by_chunk(keys)).alias("_guess"))
        guess = guess.select(*[F.col(k).alias(f"_b_{k}") for k in (*keys, "_chunk")], "_guess")
        same = F.col("_chunk") == F.col("_b__chunk")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        both = entries.join(guess, same).select(
            *keys, "_chunk", F.col("_guess").alias("_entry"), (~F.col("_entry").eqNullSafe(F.col("_guess"))).alias("_new"))
        entries = written(both, "chunk-entries")
        new = entries.where("_new").select(*keys, "_chunk", "_entry")
        entries = entries.drop("_new")
        if new.isEmpty():
            return entries
        wanted = new.select(*[F.col(k).alias(f"_b_{k}") for k in (*keys, "_chunk")], "_entry")
        wanted = F.broadcast(wanted) if spread.chunks * machine.size() <= CARRIED_VALUES else wanted
        again = folded(spread.hot_rows.join(wanted, same))
        kept = exits.join(new.drop("_entry"), null_safe_on(exits, new, [*keys, "_chunk"]), "left_anti")
        exits = written(kept.unionByName(again), "chunk-exits")


def _chunk_entries(spread: Spread, machine: Machine, keys: list[str]) -> DataFrame:
    if isinstance(machine, Tabled):
        return _tabled_entries(spread, machine, keys, RELAY_BYTES)
    return _guessed_entries(spread, machine, keys)


def fold(
    df: DataFrame,
    machine: Machine,
    keys: Sequence[str] = EVENT_KEYS,
    order: Sequence[str] = EVENT_ORDER,
    passed: str | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Run ``machine`` over each key's rows in order; its outputs become columns."""
    keys = list(keys)
    ok = F.coalesce(F.col(passed), F.lit(False)) if passed else F.lit(True)
    prepared = df.withColumn("_t", micros(order[0])).withColumn("_ok", ok)
    s = Spread(prepared, keys, order, max_rows)
    rows = s._attach(_chunk_entries(s, machine, keys), ["_entry"], machine.size()) if s.hot else s.df
    out_schema = T.StructType([*rows.schema.fields, *output_fields(machine)])
    folded = (
        rows.repartition(*keys, "_chunk")
        .sortWithinPartitions(*keys, "_chunk", *order)
        .mapInArrow(runner(machine, [*keys, "_chunk"]), out_schema)
    )
    return folded.drop("_t", "_ok", "_entry", "_chunk")


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def dedupe(events: DataFrame, cooldown_minutes: float = 30, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``fired``: false for a duplicate within the cooldown of the last fired event of its key."""
    require(cooldown_minutes > 0, "cooldown_minutes must be > 0")
    return fold(events, Cooldown(_us(60 * cooldown_minutes)), max_rows=max_rows)


def dedupe_records(fired: DataFrame, keys: Sequence[str] = EVENT_KEYS) -> DataFrame:
    """First and last fired time and the number of fired events per key."""
    at = F.when(F.col("fired"), F.col("triggered_at"))
    return fired.groupBy(*keys).agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(at).alias("count")
    )


def cooldown(events: DataFrame, seconds: float = 300, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``cooling`` (the event falls in a cooldown) and ``expires_at`` of the cooldown then running."""
    require(seconds >= 0, "seconds must be >= 0")
    out = fold(events, Cooldown(_us(seconds)), max_rows=max_rows)
    last = F.timestamp_micros("last_fired_us").cast("timestamp_ntz")
    return out.withColumn("cooling", ~F.col("fired")).withColumn("expires_at", plus_seconds(last, seconds))


def quota(
    events: DataFrame, max_alerts: int = 10, window_minutes: float = 60, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add ``allowed`` and ``current_count`` under a per-pipeline quota."""
    require(max_alerts >= 1, "max_alerts must be >= 1")
    require(window_minutes > 0, "window_minutes must be > 0")
    return fold(events, Quota(max_alerts, _us(60 * window_minutes)), ["pipeline"], max_rows=max_rows)


def rate_limit(
    events: DataFrame, max_alerts: int = 5, window_seconds: float = 300, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """The quota rule with a window in seconds."""
    return quota(events, max_alerts, window_seconds / 60, max_rows)


def backoff(
    events: DataFrame,
    base_delay: float = 60,
    multiplier: float = 2,
    max_delay: float = 3600,
    max_attempts: int = 5,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add ``due`` and ``attempts`` (made so far, this one included) per (pipeline, check)."""
    require(base_delay > 0, "base_delay must be > 0")
    require(multiplier >= 1, "multiplier must be >= 1")
    require(max_attempts >= 1, "max_attempts must be >= 1")
    return fold(events, Backoff(base_delay, multiplier, max_delay, max_attempts), max_rows=max_rows)


def circuit_breaker(
    events: DataFrame, failure_threshold: int = 5, recovery_timeout: float = 60, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add the breaker ``state`` each event meets, ``allowed`` and ``failures`` after it, per pipeline."""
    require(failure_threshold >= 1, "failure_threshold must be >= 1")
    require(recovery_timeout >= 1, "recovery_timeout must be >= 1")
    machine = Breaker(failure_threshold, _us(recovery_timeout))
    return fold(events, machine, ["pipeline"], passed="passed", max_rows=max_rows)


def batch(
    events: DataFrame, max_size: int = 10, max_age_seconds: float = 60, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Add ``batch_no`` and ``closes`` (the event that closes its batch) per pipeline."""
    require(max_size >= 1, "max_size must be >= 1")
    require(max_age_seconds > 0, "max_age_seconds must be > 0")
    return fold(events, Batch(max_size, _us(max_age_seconds)), ["pipeline"], max_rows=max_rows)


def batches(batched: DataFrame, max_size: int, keys: Sequence[str] = ("pipeline",)) -> DataFrame:
    """One row per batch: size, span, and why it was flushed (size, age, or manual for the rest)."""
    n = F.count(F.lit(1))
    closed = F.max("closes") if "closes" in batched.columns else F.lit(False)
    return batched.groupBy(*keys, "batch_no").agg(
        n.alias("size"),
        F.min("triggered_at").alias("opened_at"),
        F.max("triggered_at").alias("last_at"),
        F.when(n >= F.lit(max_size), "size").when(closed, "age").otherwise("manual").alias("reason"),
    )


def compact_flags(
    history: DataFrame,
    window_seconds: float = 60,
    keys: Sequence[str] = EVENT_KEYS,
    order: Sequence[str] = ("recorded_at", "run_id"),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add ``keep``: false for a pass within the window of the previously kept pass of its key."""
    require(window_seconds >= 0, "window_seconds must be >= 0")
    return fold(history, Compact(_us(window_seconds)), keys, order, "passed", max_rows)


def compact(
    history: DataFrame,
    window_seconds: float = 60,
    max_entries: int = 1000,
    keep_failures: bool = True,
    order: Sequence[str] = ("recorded_at", "run_id"),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Deduplicated history, cut to ``max_entries``; with ``keep_failures`` every failure stays.

    At most ``max_entries`` passes are ranked, after a distributed top-n.
    """
    require(max_entries >= 1, "max_entries must be >= 1")
    # What is not known to have passed counts as a failure.
    ok = F.coalesce(F.col("passed"), F.lit(False))
    kept = compact_flags(history, window_seconds, order=order, max_rows=max_rows).filter("keep").drop("keep")
    newest = [F.desc(c) for c in order]
    if not keep_failures:
        return kept.orderBy(*newest).limit(max_entries)
    failures = kept.filter(~ok)
    top = kept.filter(ok).orderBy(*newest).limit(max_entries)
    ranked = top.withColumn("_rank", F.row_number().over(Window.orderBy(*newest)))
    slots = F.lit(max_entries) - history.filter(~ok).agg(F.count(F.lit(1))).scalar()
    passes = ranked.withColumn("_slots", slots).filter("_rank <= _slots").drop("_rank", "_slots")
    return failures.unionByName(passes)


def compaction_stats(original: DataFrame, retained: DataFrame) -> DataFrame:
    """Original, retained and removed rows, and the reduction in percent."""
    counts = (
        original.select(F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(retained.select(F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .agg(F.coalesce(F.sum("_a"), F.lit(0)).alias("original"), F.coalesce(F.sum("_b"), F.lit(0)).alias("retained"))
    )
    removed = F.col("original") - F.col("retained")
    pct = F.coalesce(F.round(F.try_divide(removed, F.col("original")) * 100, 2), F.lit(0.0))
    return counts.select("original", "retained", removed.alias("removed"), pct.alias("reduction_pct"))
