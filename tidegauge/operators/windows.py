"""Time windows anchored at the earliest event, with empty buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.common import instant, micros, require

_BLOCK = 4096


def build_windows(
    events: DataFrame,
    reference: str | Column,
    size_seconds: float = 300,
    slide_seconds: float | None = None,
    pipeline: str | None = None,
) -> DataFrame:
    """Tumbling (or sliding) buckets ``[start, end)`` from the earliest event on, while ``start < reference``.

    Per bucket: events, failures (severity other than info) and the pipelines
    seen; buckets without events are there too. Bucket numbers come from
    integer arithmetic, so there is no range join. Events are first counted per
    (bucket, pipeline), so a bucket with very many events is pre-aggregated.
    """
    require(size_seconds > 0, "size_seconds must be positive")
    require(slide_seconds is None or 0 < slide_seconds <= size_seconds, "need 0 < slide <= size")
    size = int(round(size_seconds * 1_000_000))
    step = int(round((slide_seconds or size_seconds) * 1_000_000))
    rows = events if pipeline is None else events.filter(F.col("pipeline") == pipeline)
    anchor = rows.agg(F.min(micros("triggered_at"))).scalar()
    t = micros("triggered_at") - F.col("_anchor")
    # The buckets k with k*step <= t < k*step + size, numbered from 0.
    high = F.expr(f"(unix_micros(cast(triggered_at as timestamp)) - _anchor) div {step}")
    slim = rows.select("triggered_at", "severity", "pipeline").withColumn("_anchor", anchor)
    if step == size:
        placed = slim.withColumn("bucket", high)
    else:
        exact = F.expr(
            f"(unix_micros(cast(triggered_at as timestamp)) - _anchor - {size}) div {step} + 1"
        )
        first = F.when(t < size, F.lit(0)).otherwise(exact)
        placed = slim.withColumn("bucket", F.explode(F.sequence(first.cast("bigint"), high)))
    counted = (
        placed.groupBy("bucket", "pipeline")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") != "info").alias("bad"))
        .groupBy("bucket")
        .agg(
            F.sum("n").alias("count"),
            F.sum("bad").alias("failure_count"),
            F.array_sort(F.collect_list("pipeline")).alias("pipelines"),
        )
    )
    # All bucket numbers: blocks first, so that a long range is not made by one task.
    span = micros(instant(reference)) - F.col("_anchor")
    total = F.ceil(span / F.lit(float(step))).cast("bigint")
    blocks = (
        rows.agg(F.min(micros("triggered_at")).alias("_anchor"))
        .filter(F.col("_anchor").isNotNull() & (span > 0))
        .withColumn("_total", total)
        .withColumn("_block", F.explode(F.expr(f"sequence(0L, (_total - 1) div {_BLOCK})")))
        .repartition("_block")
    )
    numbers = blocks.withColumn(
        "bucket",
        F.explode(F.expr(f"sequence(_block * {_BLOCK}, least(_total, (_block + 1) * {_BLOCK}) - 1)")),
    )
    start = F.col("_anchor") + F.col("bucket") * F.lit(step)
    as_ts = lambda us: F.timestamp_micros(us).cast("timestamp_ntz")
    return numbers.join(counted, "bucket", "left").select(
        as_ts(start).alias("start_at"),
        as_ts(start + F.lit(size)).alias("end_at"),
        F.coalesce("count", F.lit(0)).alias("count"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"),
        F.coalesce("pipelines", F.array().cast("array<string>")).alias("pipelines"),
    )
