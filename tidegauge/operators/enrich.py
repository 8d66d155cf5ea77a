"""Projections and enrichment of events and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import metrics as M
from tidegauge.functions.common import (
    BROADCAST_ROWS,
    ascii_json_text,
    broadcast_if_small,
    col,
    hash_uniform,
    plus_seconds,
    require,
    within_rows,
)
from tidegauge.operators.filters import match_rules

# Key patterns whose values are hidden.
MASK_PATTERNS = ("password", "secret", "token", r"api[_-]?key")
REDACT_PATTERNS = ("password", "secret", "token", r"api[_-]?key", "auth", "credential")
MASK = "***"
REDACTED = "***REDACTED***"


def transform_values(df: DataFrame, fn: str = "abs", scale: float = 1.0, offset: float = 0.0, value: str = "value") -> DataFrame:
    """Add ``transformed``, ``changed`` and the ``steps`` taken."""
    steps = F.array(F.lit(f"scale({float(scale)})"), F.lit(f"offset({float(offset)})"), F.lit(f"fn({fn})"))
    out = df.withColumn("transformed", M.transformed(value, fn, scale, offset))
    return out.withColumn("changed", F.col(value) != F.col("transformed")).withColumn("steps", steps)


def transform_by_rule(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Apply each metric's rule (metric, fn, scale, offset); metrics without one are dropped."""
    r = broadcast_if_small(rules.select("metric", "fn", "scale", "offset"))
    x = F.col("value") * F.col("scale") + F.col("offset")
    out = F.raise_error(F.concat(F.lit("unknown transform: "), F.col("fn"))).cast("double")
    for name, fn in M.TRANSFORMS.items():
        out = F.when(F.col("fn") == name, fn(x)).otherwise(out)
    return metrics.join(r, "metric").withColumn("transformed", out).withColumn(
        "changed", F.col("value") != F.col("transformed")
    )


def normalize(metrics: DataFrame, rules: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Add ``normalized`` by each metric's rule (minmax, zscore or clamp).

    The last rule of a metric (largest ``rule_idx``) wins; metrics without a
    rule are dropped. ``history`` gives the z-score's mean and deviation.
    """
    fields = ["strategy", "min_val", "max_val", "clamp_low", "clamp_high"]
    picked = rules.groupBy("metric").agg(F.max_by(F.struct(*fields), "rule_idx").alias("_r"))
    few = within_rows(picked, BROADCAST_ROWS)
    r = picked.select("metric", *[F.col(f"_r.{f}").alias(f) for f in fields])
    r = F.broadcast(r) if few else r
    joined = metrics.join(r, "metric")
    if history is not None:
        # Statistics of metrics with a rule only, so there are no more of them than rules.
        stats = (
            history.join(r.select("metric"), "metric", "left_semi")
            .groupBy("metric")
            .agg(F.count("value").alias("_n"), F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_std"))
        )
        joined = joined.join(F.broadcast(stats) if few else stats, "metric", "left")
    else:
        joined = joined.withColumns({"_n": F.lit(0), "_mean": F.lit(None).cast("double"), "_std": F.lit(None).cast("double")})
    v = F.col("value")
    span = F.col("max_val") - F.col("min_val")
    minmax = F.coalesce(F.try_divide(v - F.col("min_val"), span), F.lit(0.0))
    z = F.when(
        (F.col("_n") >= 2) & (F.col("_std") > 0), F.try_divide(v - F.col("_mean"), F.col("_std"))
    ).otherwise(0.0)
    clamp = F.least(F.greatest(v, F.col("clamp_low")), F.col("clamp_high"))
    out = F.when(F.col("strategy") == "minmax", minmax).when(F.col("strategy") == "zscore", z).otherwise(clamp)
    out = F.when(v.isNotNull(), out)
    return joined.withColumn("normalized", out).drop("_n", "_mean", "_std", *fields[1:])


def _hidden_key(patterns: Sequence[str]) -> Callable[[Column], Column]:
    require(len(patterns) > 0, "patterns must not be empty")
    joined = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return lambda key: key.rlike(joined)


def hide_values(metadata: str | Column, patterns: Sequence[str], replacement: str) -> Column:
    """Replace the values of the keys that match any pattern (case-insensitive search)."""
    hit = _hidden_key(patterns)
    return F.transform_values(col(metadata), lambda k, v: F.when(hit(k), F.lit(replacement)).otherwise(v))


def hidden_keys(metadata: str | Column, patterns: Sequence[str]) -> Column:
    return F.array_sort(F.filter(F.map_keys(col(metadata)), _hidden_key(patterns)))


def mask_metadata(df: DataFrame, patterns: Sequence[str] = MASK_PATTERNS, mask: str = MASK) -> DataFrame:
    """Mask ``metadata`` and add ``masked_keys``."""
    return df.withColumn("masked_keys", hidden_keys("metadata", patterns)).withColumn(
        "metadata", hide_values("metadata", patterns, mask)
    )


def redact_metadata(df: DataFrame, patterns: Sequence[str] = REDACT_PATTERNS, text: str = REDACTED) -> DataFrame:
    return df.withColumn("metadata", hide_values("metadata", patterns, text))


def mask_columns(df: DataFrame, patterns: Sequence[str] = MASK_PATTERNS, mask: str = MASK) -> DataFrame:
    """The same rule over the column names of a wide table."""
    import re

    rx = re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE)
    return df.withColumns({c: F.lit(mask) for c in df.columns if rx.search(c)})


def merge_maps(older: Column, newer: Column) -> Column:
    """Keys of both maps; the newer value wins."""
    kept = F.map_filter(older, lambda k, _: ~F.array_contains(F.map_keys(newer), k))
    return F.map_concat(kept, newer)


def add_metadata(df: DataFrame, **values: str | Column) -> DataFrame:
    """Add or replace metadata keys with constants or string columns."""
    pairs = [x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    return df.withColumn("metadata", merge_maps(F.col("metadata"), F.create_map(*pairs)))


def enrich(df: DataFrame, enrichers: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Apply enrichers in order; a later one overwrites the keys of an earlier one."""
    for e in enrichers:
        df = df.transform(e)
    return df


def default_enrichers(environment: str, host: str) -> list[Callable[[DataFrame], DataFrame]]:
    """Environment and host (constants of the run) and the event's severity."""
    return [
        lambda d: add_metadata(d, env=environment),
        lambda d: add_metadata(d, host=host),
        lambda d: add_metadata(d, severity=F.col("severity")),
    ]


def label(events: DataFrame, rules: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``labels``: the matching rules' key -> value, a later rule overwriting an earlier one."""
    checked = rules.withColumn(
        "key", F.when(F.length("key") > 0, F.col("key")).otherwise(F.raise_error(F.lit("label key must not be empty")))
    )
    m = match_rules(events, checked, ["key", "value"], limit=limit)
    # Sorted by key and then from the last rule to the first: the first of each key stays.
    pairs = F.array_sort(F.transform(
        "matched", lambda x, i: F.struct(x["key"].alias("key"), (-i).alias("back"), x["value"].alias("value"))
    ))
    last = F.filter(pairs, lambda x, i: (i == 0) | (x["key"] != F.get(pairs, i - 1)["key"]))
    entries = F.transform(last, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    return m.withColumn("labels", F.map_from_entries(entries)).drop("matched")


def fingerprint(
    pipeline: str | Column = "pipeline", check: str | Column = "check_name", severity: str | Column = "severity"
) -> Column:
    """SHA-256 of the sorted-key JSON of check, pipeline and severity."""
    text = F.concat(
        F.lit('{"check": '), ascii_json_text(check),
        F.lit(', "pipeline": '), ascii_json_text(pipeline),
        F.lit(', "severity": '), ascii_json_text(severity), F.lit("}"),
    )
    return F.sha2(text, 256)


def with_priority(
    events: DataFrame,
    high_priority_tags: Sequence[str] = (),
    tag_bonus: int = 20,
    recurrence_weight: int = 5,
    max_recurrence_bonus: int = 50,
) -> DataFrame:
    """Add base score, bonuses and ``priority``; needs a ``recurrence`` column."""
    out = events.withColumns(
        {
            "base_score": M.base_priority("severity"),
            "recurrence_bonus": M.recurrence_bonus("recurrence", recurrence_weight, max_recurrence_bonus),
            "tag_bonus": M.tag_bonus("tags", high_priority_tags, tag_bonus),
        }
    )
    return out.withColumn("priority", F.col("base_score") + F.col("recurrence_bonus") + F.col("tag_bonus"))


def retry_plan(
    failures: DataFrame,
    base_delay: float = 60,
    multiplier: float = 2,
    max_delay: float = 3600,
    max_attempts: int = 5,
    at: str = "triggered_at",
) -> DataFrame:
    """One row per failure and attempt: its delay, the total delay and the time it is due."""
    require(base_delay > 0 and multiplier >= 1 and max_attempts >= 1, "bad backoff policy")
    attempts = F.sequence(F.lit(1), F.lit(max_attempts))
    delay = lambda n: M.retry_delay(n, base_delay, multiplier, max_delay)
    total = F.aggregate(
        F.sequence(F.lit(1), F.col("attempt")), F.lit(0.0), lambda acc, n: acc + delay(n)
    )
    out = failures.withColumn("attempt", F.explode(attempts))
    out = out.withColumn("delay_seconds", delay(F.col("attempt"))).withColumn("total_delay_seconds", total)
    return out.withColumn("retry_at", plus_seconds(at, F.col("total_delay_seconds")))


def with_jitter(
    plan: DataFrame,
    strategy: str = "full",
    low: float = 0.0,
    high: float = 30.0,
    key: str = "event_id",
    seed: int = 0,
) -> DataFrame:
    """Add ``jittered_seconds``; the draw is a hash of (key, attempt, seed)."""
    u = hash_uniform(key, "attempt", seed=seed)
    return plan.withColumn("jittered_seconds", M.jittered("delay_seconds", u, strategy, low, high))
