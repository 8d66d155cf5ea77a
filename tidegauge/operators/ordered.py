"""Ordered per-key operators with a closed form: streaks, throttling, batching by size, watermarks.

All run through :class:`Spread`, so a key with a large share of the rows is cut
into chunks. Order is (time, id); ties in time are broken by the id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.common import (
    broadcast_if_small,
    instant,
    micros,
    order_mark,
    require,
    salted_join,
)
from tidegauge.operators.spread import MAX_ROWS, Spread

EVENT_KEYS = ("pipeline", "check_name")
EVENT_ORDER = ("triggered_at", "event_id")


def latest_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """The newest row per key, by aggregation (no sort)."""
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    )
    return picked.select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def diff_previous(
    df: DataFrame,
    keys: Sequence[str] = ("pipeline", "metric"),
    order: Sequence[str] = ("recorded_at",),
    value: str = "value",
    signed_pct: bool = False,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Each value against the previous one of its key; the first of a key gives no row.

    ``pct_change`` divides by ``abs(previous)``; ``signed_pct`` divides by the
    previous value itself and rounds to two digits. Null when it is zero.
    """
    s = Spread(df, keys, order, max_rows).lag(previous=value)
    delta = F.col(value) - F.col("previous")
    if signed_pct:
        pct = F.round(F.try_divide(delta, F.col("previous")) * 100, 2)
    else:
        pct = F.try_divide(delta, F.abs("previous")) * 100
    return (
        s.result()
        .filter(F.col("previous").isNotNull())
        .select(
            *keys,
            *order,
            "previous",
            F.col(value).alias("current"),
            delta.alias("delta"),
            pct.alias("pct_change"),
        )
    )


def failure_streaks(
    events: DataFrame,
    keys: Sequence[str] = EVENT_KEYS,
    order: Sequence[str] = EVENT_ORDER,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add ``streak``: consecutive failures of the key up to and with this row (0 on a pass)."""
    s = Spread(events, keys, order, max_rows).position("_pos")
    s.running(_last_pass=("max", F.when(F.col("passed"), F.col("_pos"))))
    streak = F.col("_pos") - F.coalesce("_last_pass", F.lit(0))
    return s.with_columns({"streak": streak}).result().drop("_pos", "_last_pass")


def debounce(events: DataFrame, threshold: int = 2, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``streak`` and ``fires``: every failure from the ``threshold``-th in a row on."""
    require(threshold >= 1, "threshold must be >= 1")
    out = failure_streaks(events, max_rows=max_rows)
    return out.withColumn("fires", F.col("streak") >= F.lit(threshold))


def current_streaks(
    runs: DataFrame, keys: Sequence[str], order: Sequence[str], salt: str
) -> DataFrame:
    """Failures after the last pass of each key, at its newest row.

    Two aggregations joined per key; no window, so a frequent key is not
    gathered.
    """
    at = order_mark(runs, order)
    last_pass = runs.groupBy(*keys).agg(F.max(F.when(F.col("passed"), at)).alias("_pass"))
    after = salted_join(runs, last_pass, keys, salt)
    newer = F.col("_pass").isNull() | (at > F.col("_pass"))
    return after.groupBy(*keys).agg(F.count_if(newer).alias("streak"))


def escalation(
    runs: DataFrame,
    policies: DataFrame,
    order: Sequence[str] = ("recorded_at", "run_id"),
    salt: str = "run_id",
) -> DataFrame:
    """Escalation verdict per policy (pipeline, check_name, threshold, notify_every)."""
    keys = ["pipeline", "check_name"]
    wanted = runs.join(broadcast_if_small(policies.select(*keys).distinct()), keys, "left_semi")
    streaks = current_streaks(wanted, keys, order, salt)
    n = F.coalesce("streak", F.lit(0))
    excess = n - F.col("threshold")
    due = (excess >= 0) & (excess % F.col("notify_every") == 0)
    # The wording of the reasons.
    text = (
        F.when(excess < 0, F.format_string("only %d/%d consecutive failures", n, F.col("threshold")))
        .when(
            due,
            F.format_string(
                "threshold %d reached; notify_every=%d", F.col("threshold"), F.col("notify_every")
            ),
        )
        .otherwise(
            F.format_string("threshold crossed but not at notify_every boundary (excess=%d)", excess)
        )
    )
    return policies.join(streaks, keys, "left").select(
        *keys,
        "threshold",
        "notify_every",
        n.alias("consecutive_failures"),
        due.alias("escalate"),
        text.alias("reason"),
    )


def throttle(
    events: DataFrame,
    cooldown_minutes: float = 30,
    max_suppressed: int | None = None,
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add the throttle state of each event: ``throttled``, ``suppressed_count``, ``first_fired``.

    Every event is recorded, so a run lasts while gaps stay below the cooldown.
    """
    require(cooldown_minutes >= 1, "cooldown_minutes must be >= 1")
    gap = int(cooldown_minutes * 60_000_000)
    s = Spread(events, EVENT_KEYS, EVENT_ORDER, max_rows).lag(_before="triggered_at")
    starts = F.col("_before").isNull() | (micros("triggered_at") - micros("_before") >= F.lit(gap))
    s.with_columns({"_starts": starts}).position("_pos")
    s.running(
        _run_pos=("max", F.when(F.col("_starts"), F.col("_pos"))),
        first_fired=("max", F.when(F.col("_starts"), F.col("triggered_at"))),
    )
    suppressed = F.col("_pos") - F.col("_run_pos")
    throttled = suppressed > 0
    if max_suppressed is not None:
        throttled = throttled & (suppressed - 1 < F.lit(max_suppressed))
    return (
        s.with_columns({"suppressed_count": suppressed, "throttled": throttled})
        .result()
        .drop("_before", "_starts", "_pos", "_run_pos")
    )


def buffer_by_size(
    events: DataFrame,
    max_size: int = 50,
    keys: Sequence[str] = ("pipeline",),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """Add ``batch_no`` of a buffer that is flushed when it holds ``max_size`` events."""
    require(max_size >= 1, "max_size must be >= 1")
    s = Spread(events, keys, EVENT_ORDER, max_rows).position("_pos")
    number = F.floor((F.col("_pos") - 1) / F.lit(max_size))
    return s.with_columns({"batch_no": number}).result().drop("_pos")


def watermark_advance(
    events: DataFrame, arrival: Sequence[str], event_time: str, now: str | Column, max_rows: int | None = MAX_ROWS
) -> DataFrame:
    """Per pipeline in arrival order: ``watermark`` so far, ``late`` flag and lag at ``now``."""
    s = Spread(events, ["pipeline"], arrival, max_rows).running(watermark=("max", F.col(event_time)))
    s.lag(_before="watermark")
    late = F.coalesce(F.col(event_time) <= F.col("_before"), F.lit(False))
    lag = F.greatest(F.lit(0.0), (micros(instant(now)) - micros("watermark")) / F.lit(1_000_000.0))
    return s.with_columns({"late": late, "lag_seconds": lag}).result().drop("_before")


def recurrence(events: DataFrame, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """Add ``recurrence``: how often the (pipeline, check) has occurred so far."""
    return Spread(events, EVENT_KEYS, EVENT_ORDER, max_rows).position("recurrence").result()
