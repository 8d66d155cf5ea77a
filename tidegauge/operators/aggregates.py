"""Aggregations over events, run histories, metric series, samples and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.common import (
    col,
    instant,
    micros,
    plus_seconds,
    require,
    salted_join,
    severity_of_rank,
    severity_rank,
    written,
)
from tidegauge.operators.enrich import fingerprint
from tidegauge.operators.spread import MAX_ROWS, Spread

GROUP_KEYS = {"pipeline": "pipeline", "check": "check_name", "severity": "severity"}


def aggregate_recent(
    events: DataFrame,
    now: str | Column,
    window_seconds: float = 60,
    max_events: int = 100,
    group_by: str = "pipeline",
) -> DataFrame:
    """Events of the last window, the first ``max_events`` of them, grouped.

    The lists are bounded by ``max_events``.
    """
    require(group_by in GROUP_KEYS, f"group_by must be one of {sorted(GROUP_KEYS)}")
    require(max_events >= 1, "max_events must be >= 1")
    since = plus_seconds(instant(now), -float(window_seconds))
    first = (
        events.filter(F.col("triggered_at") >= since)
        .select("triggered_at", "event_id", "severity", F.col(GROUP_KEYS[group_by]).alias("key"))
        .orderBy("triggered_at", "event_id")
        .limit(max_events)
    )
    listed = F.array_sort(F.collect_list(F.struct("triggered_at", "event_id", "severity")))
    return first.groupBy("key").agg(F.count(F.lit(1)).alias("count"), listed.alias("_l")).select(
        "key",
        "count",
        F.transform("_l", lambda x: x["event_id"]).alias("event_ids"),
        F.transform("_l", lambda x: x["severity"]).alias("severities"),
    )


def group_events(events: DataFrame, key: str | Column = "pipeline") -> DataFrame:
    """Count and highest severity per key."""
    return (
        events.groupBy(col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("count"), F.min(severity_rank("severity")).alias("_rank"))
        .select("key", "count", severity_of_rank(F.col("_rank")).alias("highest_severity"))
    )


def partition_counts(events: DataFrame, key: str | Column = "pipeline") -> DataFrame:
    """Rows per named partition, and a total row (``partition`` null)."""
    return events.select(col(key).alias("partition")).rollup("partition").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("partition").cast("boolean").alias("is_total")
    )


def group_by_tag(events: DataFrame) -> DataFrame:
    """An event counts once in each of its tags; events without tags count as ``(untagged)``."""
    tags = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit("(untagged)")))
    exploded = events.select(F.explode(F.array_distinct(tags)).alias("tag"))
    return exploded.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def fingerprint_counts(events: DataFrame) -> DataFrame:
    """Occurrences and first time per fingerprint; grouped by the fields, hashed once per group."""
    keys = ["pipeline", "check_name", "severity"]
    return (
        events.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"), F.min("triggered_at").alias("first_seen"))
        .withColumn("digest", fingerprint())
    )


def health_score(
    events: DataFrame,
    critical: int = 40,
    warning: int = 15,
    info: int = 5,
    max_score: int = 100,
) -> DataFrame:
    """Score per pipeline: ``max_score`` minus the weights of its events, not below 0.

    ``deductions`` lists each rule once with its weight and count.
    """
    require(min(critical, warning, info) >= 0, "weights must be >= 0")
    require(max_score > 0, "max_score must be > 0")
    s = F.lower("severity")
    weight = F.when(s == "critical", critical).when(s == "warning", warning).when(s == "info", info).otherwise(0)
    per_rule = events.groupBy("pipeline", "rule_name", weight.cast("bigint").alias("_w")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    note = F.when(F.col("_w") > 0, F.format_string("%s(-%d) x%d", "rule_name", "_w", "_n"))
    score = F.greatest(F.lit(0), F.least(F.lit(max_score), F.lit(max_score) - F.col("_sum")))
    return (
        per_rule.groupBy("pipeline")
        .agg(
            F.sum("_n").alias("event_count"),
            F.sum(F.col("_w") * F.col("_n")).alias("_sum"),
            F.array_sort(F.collect_list(note)).alias("deductions"),
        )
        .withColumn("score", score)
        .select(
            "pipeline",
            "score",
            F.lit(max_score).cast("bigint").alias("max_score"),
            "event_count",
            "deductions",
            (F.col("score") > F.lit(max_score // 2)).alias("healthy"),
            F.round(F.col("score") / F.lit(max_score) * 100, 1).alias("pct"),
        )
    )


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, rank: str = "rank") -> DataFrame:
    """The newest ``limit`` rows per key with their ``rank``; each task keeps ``limit`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= limit)


def trend(
    history: DataFrame,
    limit: int = 20,
    keys: Sequence[str] = ("pipeline",),
    order: Sequence[str] = ("recorded_at", "run_id"),
) -> DataFrame:
    """Totals, pass rate, failure streak and last status of the newest ``limit`` runs per key."""
    require(limit >= 1, "limit must be >= 1")
    rows = newest_per_key(history, keys, order, limit)
    n, ok = F.count(F.lit(1)), F.count_if(F.col("status") == "PASS")
    first_ok = F.min(F.when(F.col("status") != "FAIL", F.col("rank")))
    return rows.groupBy(*keys).agg(
        n.alias("total_runs"),
        ok.alias("passed_runs"),
        (n - ok).alias("failed_runs"),
        (ok / n).alias("pass_rate"),
        F.coalesce(first_ok - 1, n).alias("consecutive_failures"),
        F.min_by("status", "rank").alias("last_status"),
    )


def digest(
    history: DataFrame,
    now: str | Column,
    period_hours: float = 24,
    order: Sequence[str] = ("recorded_at", "run_id"),
    salt: str = "run_id",
) -> DataFrame:
    """Runs, passes, streak and status per pipeline over the period."""
    from tidegauge.operators.ordered import current_streaks

    since = plus_seconds(instant(now), -3600.0 * period_hours)
    rows = history.filter(F.col("recorded_at") >= since)
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    totals = rows.groupBy("pipeline").agg(
        n.alias("total_runs"),
        ok.alias("passed_runs"),
        (n - ok).alias("failed_runs"),
        (ok / n).alias("pass_rate"),
        F.max("recorded_at").alias("last_run_at"),
    )
    streaks = current_streaks(rows, ["pipeline"], order, salt)
    return (
        totals.join(streaks.withColumnRenamed("pipeline", "_p"), F.col("pipeline").eqNullSafe(F.col("_p")))
        .drop("_p")
        .withColumnRenamed("streak", "consecutive_failures")
        .withColumn("status", F.when(F.col("consecutive_failures") == 0, "OK").otherwise("DEGRADED"))
    )


def digest_totals(digested: DataFrame) -> DataFrame:
    """One row: pipelines, how many are healthy and degraded."""
    bad = F.count_if(F.col("consecutive_failures") > 0)
    n = F.count(F.lit(1))
    return digested.agg(n.alias("pipelines"), (n - bad).alias("healthy"), bad.alias("degraded"))


_WORD = 60


def correlate(
    history: DataFrame,
    limit: int = 50,
    overall: bool = False,
    order: Sequence[str] = ("recorded_at", "run_id"),
    blocks: int = 16,
) -> DataFrame:
    """Pearson correlation of the pass/fail series of every two pipelines, newest first.

    ``limit`` keeps the newest runs per pipeline, or of the whole history with
    ``overall``. A series is packed into 60-bit words, so a pair costs a few bit
    counts. Pipelines are hashed into blocks and joined block by block on
    equality; the work is that of the pairs in the result.
    """
    require(limit >= 2, "limit must be >= 2")
    if overall:
        history = history.orderBy(*[F.desc(c) for c in order]).limit(limit)
    rows = newest_per_key(history.select("pipeline", "passed", *order), ["pipeline"], order, limit)
    at = F.col("rank") - 1
    bit = F.when(F.col("passed"), F.expr(f"shiftleft(1L, (rank - 1) % {_WORD})")).otherwise(F.lit(0))
    words = rows.groupBy("pipeline", F.floor(at / _WORD).alias("word")).agg(
        F.sum(bit).alias("bits"), F.count(F.lit(1)).alias("n")
    )
    if limit <= _WORD:
        packed = words
    else:
        sizes = words.groupBy("pipeline").agg(F.sum("n").alias("n"))
        packed = words.drop("n").join(sizes, "pipeline")
    b = F.pmod(F.xxhash64("pipeline"), F.lit(blocks)).cast("int")
    spread = packed.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    side = spread.select("pipeline", "word", "bits", "n", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))
    x, y = side.alias("x"), side.alias("y")
    on = (
        (F.col("x.lo") == F.col("y.lo"))
        & (F.col("x.hi") == F.col("y.hi"))
        & (F.col("x.word") == F.col("y.word"))
        & (F.col("x.pipeline") < F.col("y.pipeline"))
        & ((F.col("x.b") != F.col("y.b")) | (F.col("x.lo") == F.col("x.hi")))
    )
    n = F.least("x.n", "y.n")
    here = F.greatest(F.lit(0), F.least(n - F.col("x.word") * _WORD, F.lit(_WORD)))
    pairs = x.join(y, on).select(
        F.col("x.pipeline").alias("pipeline_a"),
        F.col("y.pipeline").alias("pipeline_b"),
        n.alias("n"),
        F.col("x.bits").alias("_x"),
        F.col("y.bits").alias("_y"),
        here.cast("int").alias("_m"),
    )
    mask = F.expr("shiftleft(1L, _m) - 1")
    counted = pairs.select(
        "pipeline_a",
        "pipeline_b",
        "n",
        F.bit_count(F.col("_x").bitwiseAND(mask)).cast("bigint").alias("sx"),
        F.bit_count(F.col("_y").bitwiseAND(mask)).cast("bigint").alias("sy"),
        F.bit_count(F.col("_x").bitwiseAND(F.col("_y")).bitwiseAND(mask)).cast("bigint").alias("sxy"),
    )
    if limit > _WORD:
        counted = counted.groupBy("pipeline_a", "pipeline_b", "n").agg(
            *[F.sum(c).alias(c) for c in ("sx", "sy", "sxy")]
        )
    size, sx, sy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxy"))
    spread_x, spread_y = size * sx - sx * sx, size * sy - sy * sy
    score = F.coalesce(
        F.try_divide(size * sxy - sx * sy, F.sqrt(spread_x.cast("double") * spread_y)), F.lit(0.0)
    )
    return counted.filter("n >= 2").select(
        "pipeline_a", "pipeline_b", F.round(score, 4).alias("score"), size.alias("sample_size")
    )


def strong_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    return pairs.filter(F.abs("score") >= F.lit(threshold))


def anomalies(current: DataFrame, history: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Population z-score of each current value against its key's history.

    With fewer than two points the z-score is 0 and the mean is the point, or
    the value itself.
    """
    require(threshold > 0, "threshold must be > 0")
    keys = ["pipeline", "metric"]
    stats = history.groupBy(*keys).agg(
        F.count("value").alias("_n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std")
    )
    joined = current.join(stats, keys, "left")
    enough = F.coalesce(F.col("_n"), F.lit(0)) >= 2
    mean = F.coalesce(F.col("_mean"), F.col("value"))
    std = F.when(enough, F.col("_std")).otherwise(0.0)
    z = F.coalesce(F.try_divide(F.abs(F.col("value") - mean), std), F.lit(0.0))
    return joined.withColumns({"mean": mean, "stddev": std}).withColumn("z_score", z).withColumn(
        "is_anomaly", F.col("z_score") > F.lit(float(threshold))
    ).drop("_n", "_mean", "_std")


def newest_anomalies(metrics: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Population z-score of each series' last value against all values before it.

    Of several values at the last time the greatest is the current one, and none of them is history.
    """
    keys = ["pipeline", "metric"]
    newest = metrics.groupBy(*keys).agg(F.max(F.struct("recorded_at", "value")).alias("_newest"))
    newest = newest.select(*keys, F.col("_newest.recorded_at").alias("_until"), F.col("_newest.value").alias("value"))
    past = salted_join(metrics, newest.drop("value"), keys, salt="recorded_at").filter(F.col("recorded_at") < F.col("_until"))
    return anomalies(newest.drop("_until"), past.drop("_until"), threshold)


def rolling_anomalies(
    metrics: DataFrame,
    points: int = 30,
    threshold: float = 3.0,
    order: Sequence[str] = ("recorded_at",),
    max_rows: int | None = MAX_ROWS,
) -> DataFrame:
    """z-score of every point against the ``points`` before it in its series."""
    require(points >= 2, "points must be >= 2")
    keys = ["pipeline", "metric"]
    rows = Spread(metrics, keys, order, max_rows).with_context(points)
    past = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(-points, -1)
    out = rows.withColumns({
        "mean": F.coalesce(F.avg("value").over(past), F.col("value")),
        "stddev": F.when(F.count("value").over(past) >= 2, F.stddev_pop("value").over(past)).otherwise(0.0),
    }).filter(~F.col("_context")).drop("_context", "_chunk")
    z = F.coalesce(F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("stddev")), F.lit(0.0))
    return out.withColumn("z_score", z).withColumn("is_anomaly", F.col("z_score") > F.lit(float(threshold)))


def _line(metrics: DataFrame) -> DataFrame:
    """Least-squares line of value on hours per series, in one aggregation."""
    x = micros("recorded_at") / F.lit(3_600_000_000.0)
    y = F.col("value")
    return metrics.groupBy("pipeline", "metric").agg(
        F.count(F.lit(1)).alias("points"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        F.max(x).alias("_last"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("_slope"),
        F.regr_r2(y, x).alias("_r2"),
        F.var_pop(y).alias("_vy"),
    )


def _at_horizon(hours: float) -> Column:
    return F.col("_my") + F.col("_slope") * (F.col("_last") + F.lit(float(hours)) - F.col("_mx"))


def _confidence() -> Column:
    r2 = F.when(F.col("_vy") == 0, 1.0).otherwise(F.coalesce("_r2", F.lit(0.0)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), r2))


def forecast(metrics: DataFrame, horizon_hours: float = 24, min_points: int = 3) -> DataFrame:
    """Linear forecast per series; NaN with a warning when there are too few points."""
    require(min_points >= 2, "min_points must be >= 2")
    few = F.col("points") < F.lit(min_points)
    return _line(metrics).select(
        "pipeline",
        "metric",
        "points",
        F.when(few, F.lit(float("nan"))).otherwise(F.round(_at_horizon(horizon_hours), 6)).alias("predicted_value"),
        F.when(few, 0.0).otherwise(F.round(_confidence(), 4)).alias("confidence"),
        F.when(few, F.format_string(f"insufficient history (%d/{min_points} points)", "points")).alias("warning"),
    )


def project(metrics: DataFrame, horizon_hours: float = 24) -> DataFrame:
    """Linear projection per series with at least two points."""
    require(horizon_hours > 0, "horizon_hours must be > 0")
    return (
        _line(metrics)
        .filter("points >= 2")
        .select(
            "pipeline",
            "metric",
            _at_horizon(horizon_hours).alias("projected_value"),
            _confidence().alias("confidence"),
            F.col("points").alias("based_on"),
        )
    )


#: Values between which a rank is looked for are counted one by one when there are no more per key.
EXACT_ROWS = 200_000
BUCKETS = 4_096


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that a value is in; it never falls as the value rises.

    On a logarithmic scale, so that a few outliers do not put all else into one bucket;
    where the logarithms are too close to tell apart, on a linear one.
    """
    def scaled(x: Column) -> Column:
        return F.signum(x) * F.log1p(F.abs(x))

    log = F.try_divide(scaled(value) - scaled(low), scaled(high) - scaled(low))
    linear = F.try_divide(value - low, high - low)
    return F.floor(F.coalesce(log, linear, F.lit(0.0)) * BUCKETS)


def values_at(rows: DataFrame, keys: Sequence[str], value: str, wanted: DataFrame, exact_rows: int = EXACT_ROWS) -> DataFrame:
    """``keys`` and ``value_at``: the value at a 1-based rank in ascending order, without sorting the rows.

    ``wanted`` has the keys, ``_low`` and ``_high`` (least and greatest value, both finite),
    ``_inside`` (how many there are) and ``_nth``. Each round counts the values per bucket and
    goes on with the one that holds the rank, until it has few enough to count them singly.
    """
    keys = list(keys)
    v = F.col(value)
    bounds = written(wanted.select(*keys, "_low", "_high", "_inside", "_nth"), "rank-bounds")
    slim = rows.select(*keys, value, F.monotonically_increasing_id().alias("_salt_of"))
    while True:
        inside = salted_join(slim, bounds, keys, salt="_salt_of", how="inner").filter(v.between(F.col("_low"), F.col("_high")))
        open_ = bounds.filter((F.col("_low") < F.col("_high")) & (F.col("_inside") > exact_rows))
        if open_.isEmpty():
            break
        counted = inside.groupBy(*keys, "_nth", _bucket(v, F.col("_low"), F.col("_high")).alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_inside"), F.min(v).alias("_low"), F.max(v).alias("_high"))
        # A key has no more than ``BUCKETS`` + 1 of them.
        up_to = F.sum("_inside").over(Window.partitionBy(*keys).orderBy("_bucket"))
        counted = counted.withColumn("_up_to", up_to)
        held = counted.filter((F.col("_up_to") >= F.col("_nth")) & (F.col("_up_to") - F.col("_inside") < F.col("_nth")))
        bounds = written(
            held.select(*keys, "_low", "_high", "_inside", (F.col("_nth") - F.col("_up_to") + F.col("_inside")).alias("_nth")),
            "rank-bounds")
    single = inside.groupBy(*keys, "_nth", v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    single = single.withColumn("_up_to", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")))
    return single.filter(F.col("_up_to") >= F.col("_nth")).groupBy(*keys).agg(F.min("_v").alias("value_at"))


def profile_report(
    samples: DataFrame, keys: Sequence[str] = ("pipeline", "check_name"), exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """Count, mean, 95th percentile by rank and sample deviation of durations per key.

    In the order of ranks null durations come first, then negative infinity, numbers,
    positive infinity and NaN.
    """
    keys, d = list(keys), F.col("duration_ms")
    infinite, nan = F.abs(d) == float("inf"), F.isnan(d)
    finite = F.when(d.isNotNull() & ~nan & ~infinite, d)
    stats = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(d).alias("mean_ms"),
        F.when(F.count(F.lit(1)) >= 2, F.stddev_samp(d)).alias("stdev_ms"),
        F.count_if(d.isNull()).alias("_nulls"), F.count_if(infinite & (d < 0)).alias("_below"),
        F.count_if(infinite & (d > 0)).alias("_above"), F.count(finite).alias("_inside"),
        F.min(finite).alias("_low"), F.max(finite).alias("_high"),
    )
    rank = F.greatest(F.lit(1), F.floor(F.col("count") * F.lit(0.95)))
    stats = written(stats.withColumn("_nth", rank - F.col("_nulls") - F.col("_below")), "profile")
    wanted = stats.filter("_nth between 1 and _inside")
    found = values_at(samples.select(*keys, finite.alias("duration_ms")), keys, "duration_ms", wanted, exact_rows)
    found = found.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "value_at")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    past = F.col("_nth") - F.col("_inside")
    other = (
        F.when(past > F.col("_above"), F.lit(float("nan"))).when(past > 0, F.lit(float("inf")))
        .when(F.col("_nth") + F.col("_below") > 0, F.lit(float("-inf")))
    )
    p95 = F.when(F.col("_nth").between(1, F.col("_inside")), F.col("value_at")).otherwise(other)
    return stats.join(found, same, "left").select(*keys, "count", "mean_ms", p95.alias("p95_ms"), "stdev_ms")


def shadow_summary(alerts: DataFrame) -> DataFrame:
    """What shadow mode would have fired, per pipeline."""
    n = F.count(F.lit(1))
    return alerts.groupBy("pipeline").agg(n.alias("evaluated"), n.alias("would_alert"))


def span_durations(spans: DataFrame) -> DataFrame:
    """Add ``duration_ms`` (three digits; null while the span is open)."""
    return spans.withColumn(
        "duration_ms", F.round((micros("ended_at") - micros("started_at")) / F.lit(1000.0), 3)
    )


def trace_rollup(spans: DataFrame) -> DataFrame:
    """Span count, failed and open spans, and the first root span per trace."""
    root = F.when(F.col("parent_span_id").isNull(), F.struct("started_at", "span_id", "duration_ms"))
    return (
        span_durations(spans)
        .groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("spans"),
            F.count_if(F.col("status") == "error").alias("failed_spans"),
            F.count_if(F.col("ended_at").isNull()).alias("open_spans"),
            F.min(root).alias("_root"),
        )
        .select(
            "trace_id", "spans", "failed_spans", "open_spans",
            F.col("_root.span_id").alias("root_span"), F.col("_root.duration_ms").alias("root_ms"),
        )
    )


def usage(events: DataFrame, now: str | Column, window_minutes: float = 60) -> DataFrame:
    """Events per pipeline in the last window."""
    since = plus_seconds(instant(now), -60.0 * window_minutes)
    return (
        events.filter(F.col("triggered_at") >= since)
        .groupBy("pipeline")
        .agg(F.count(F.lit(1)).alias("usage"))
    )
