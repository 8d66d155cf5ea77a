"""Per-key ordered operators, greedy folds and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import checks as C
from tidegauge.operators import filters as R
from tidegauge.operators import fold as K
from tidegauge.operators import ordered as O
from tidegauge.operators.aggregates import health_score
from tidegauge.operators.windows import build_windows
from tidegauge.plans.aggregate_queries import HEALTH_SQL
from tidegauge.plans.filter_queries import (
    MAINTENANCE_SQL,
    SILENCED,
    maintenance,
    silence_rules,
)
from tidegauge.plans.registry import query, rule_table
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import AS_OF, with_tables

EVENTS = with_tables("alert_event")
METRICS = with_tables("metric")
WALK = with_tables("alert_event", recursive=True)
BY_CHECK = "e AS (SELECT *, row_number() OVER (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id) AS rn FROM alert_event)"
BY_PIPELINE = "e AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY triggered_at, event_id) AS rn FROM alert_event)"


def slim(spark, folder):
    return D.alert_events(spark, folder).select(
        "event_id", "pipeline", "check_name", "severity", "passed", "triggered_at"
    )


@query(
    "latest_per_key",
    f"{METRICS} SELECT pipeline, metric, max_by(value, recorded_at) AS value, max(recorded_at) AS recorded_at FROM metric GROUP BY ALL",
)
def latest_per_key(spark, folder):
    return O.latest_per_key(D.metrics(spark, folder), ["pipeline", "metric"], ["recorded_at"], ["value", "recorded_at"])


@query(
    "diff_previous",
    f"""{METRICS}, p AS (SELECT *, lag(value) OVER (PARTITION BY pipeline, metric ORDER BY recorded_at) AS previous FROM metric)
SELECT pipeline, metric, recorded_at, previous, value AS current, round(value - previous, 6) AS delta,
  round((value - previous) / abs(nullif(previous, 0)) * 100, 6) AS pct_change FROM p WHERE previous IS NOT NULL""",
)
def diff_previous(spark, folder):
    out = O.diff_previous(D.metrics(spark, folder))
    return out.withColumn("delta", F.round("delta", 6)).withColumn("pct_change", F.round("pct_change", 6))


@query(
    "snapshot_diff",
    f"""{METRICS}, p AS (SELECT *, lag(value) OVER (PARTITION BY pipeline, metric ORDER BY recorded_at) AS previous FROM metric)
SELECT pipeline, metric, recorded_at, round((value - previous) / nullif(previous, 0) * 100, 1) AS pct_change FROM p WHERE previous IS NOT NULL""",
)
def snapshot_diff(spark, folder):
    out = O.diff_previous(D.metrics(spark, folder), signed_pct=True)
    exact = F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100
    return out.select("pipeline", "metric", "recorded_at", F.round(exact, 1).alias("pct_change"))


@query(
    "debounce",
    f"""{EVENTS}, i AS (SELECT *, sum(passed::INT) OVER (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id) AS island FROM alert_event),
s AS (SELECT event_id, CASE WHEN passed THEN 0 ELSE row_number() OVER (PARTITION BY pipeline, check_name, island, passed ORDER BY triggered_at, event_id) END AS streak FROM i)
SELECT event_id, streak, streak >= 2 AS fires FROM s""",
)
def debounce(spark, folder):
    return O.debounce(slim(spark, folder), 2).select("event_id", "streak", "fires")


POLICIES = [
    ("2-HIGH", "order_status", 1, 1),
    ("2-HIGH", "order_status", 1, 2),
    ("1-URGENT", "order_status", 2, 1),
    ("5-LOW", "order_status", 5, 1),
    ("5-LOW", "no such check", 3, 1),
]
ESCALATION_SQL = """lp AS (SELECT pipeline, check_name, max((recorded_at, run_id)) FILTER (passed) AS lp FROM h GROUP BY ALL),
st AS (SELECT h.pipeline, h.check_name, count(*) FILTER (lp IS NULL OR (recorded_at, run_id) > lp) AS s FROM h JOIN lp USING (pipeline, check_name) GROUP BY ALL),
r AS (SELECT pol.*, coalesce(s, 0) AS n FROM pol LEFT JOIN st USING (pipeline, check_name))
SELECT pipeline, check_name, threshold, notify_every, n AS consecutive_failures, n >= threshold AND (n - threshold) % notify_every = 0 AS escalate,
  CASE WHEN n < threshold THEN 'only ' || n || '/' || threshold || ' consecutive failures'
    WHEN (n - threshold) % notify_every = 0 THEN 'threshold ' || threshold || ' reached; notify_every=' || notify_every
    ELSE 'threshold crossed but not at notify_every boundary (excess=' || (n - threshold) || ')' END AS reason FROM r"""


@query(
    "escalation",
    f"""{with_tables('history')}, pol(pipeline, check_name, threshold, notify_every) AS (VALUES ('2-HIGH', 'order_status', 1, 1), ('2-HIGH', 'order_status', 1, 2),
  ('1-URGENT', 'order_status', 2, 1), ('5-LOW', 'order_status', 5, 1), ('5-LOW', 'no such check', 3, 1)),
h AS (SELECT pipeline, check_name, recorded_at, run_id, passed AND run_id % 7 < 2 AS passed FROM history), {ESCALATION_SQL}""",
)
def escalation(spark, folder):
    h = D.history(spark, folder).withColumn("passed", F.col("passed") & (F.col("run_id") % 7 < 2))
    policies = rule_table(spark, "pipeline string, check_name string, threshold int, notify_every int", POLICIES)
    return O.escalation(h, policies)


@query(
    "escalation_every_key",
    f"""{EVENTS}, pol AS (SELECT DISTINCT pipeline, check_name, 1 AS threshold, 2 AS notify_every FROM alert_event),
h AS (SELECT pipeline, check_name, triggered_at AS recorded_at, event_id AS run_id, value >= 30 AS passed FROM alert_event), {ESCALATION_SQL}""",
)
def escalation_every_key(spark, folder):
    e = D.alert_events(spark, folder).withColumn("passed", F.col("value") >= 30)
    policies = e.select("pipeline", "check_name").distinct().select(
        "*", F.lit(1).alias("threshold"), F.lit(2).alias("notify_every")
    )
    return O.escalation(e, policies, ("triggered_at", "event_id"), "event_id")


@query(
    "dedupe",
    f"""{WALK}, {BY_CHECK}, f AS (SELECT pipeline, check_name, triggered_at, event_id FROM e WHERE rn = 1
UNION ALL SELECT n.* FROM f, LATERAL (SELECT pipeline, check_name, triggered_at, event_id FROM e WHERE e.pipeline = f.pipeline AND e.check_name = f.check_name
  AND e.triggered_at >= f.triggered_at + INTERVAL 12 HOUR ORDER BY triggered_at, event_id LIMIT 1) n)
SELECT e.event_id, f.event_id IS NOT NULL AS fired FROM e LEFT JOIN f USING (event_id)""",
)
def dedupe(spark, folder):
    return K.dedupe(slim(spark, folder), 720).select("event_id", "fired")


@query(
    "dedupe_records",
    f"""{WALK}, {BY_CHECK}, f AS (SELECT pipeline, check_name, triggered_at, rn FROM e WHERE rn = 1
UNION ALL SELECT e.pipeline, e.check_name, CASE WHEN e.triggered_at >= f.triggered_at + INTERVAL 24 HOUR THEN e.triggered_at ELSE f.triggered_at END, e.rn
  FROM f JOIN e ON e.pipeline = f.pipeline AND e.check_name = f.check_name AND e.rn = f.rn + 1)
SELECT pipeline, check_name, min(triggered_at) AS first_seen, max(triggered_at) AS last_seen, count(DISTINCT triggered_at) AS count FROM f GROUP BY ALL""",
)
def dedupe_records(spark, folder):
    return K.dedupe_records(K.dedupe(slim(spark, folder), 1440))


@query(
    "cooldown",
    f"""{WALK}, {BY_CHECK}, f AS (SELECT pipeline, check_name, event_id, rn, triggered_at AS last, false AS cooling FROM e WHERE rn = 1
UNION ALL SELECT e.pipeline, e.check_name, e.event_id, e.rn, CASE WHEN e.triggered_at - last < INTERVAL 6 HOUR THEN last ELSE e.triggered_at END, e.triggered_at - last < INTERVAL 6 HOUR
  FROM f JOIN e ON e.pipeline = f.pipeline AND e.check_name = f.check_name AND e.rn = f.rn + 1)
SELECT event_id, cooling, last + INTERVAL 6 HOUR AS expires_at FROM f""",
)
def cooldown(spark, folder):
    return K.cooldown(slim(spark, folder), 6 * 3600).select("event_id", "cooling", "expires_at")


@query(
    "throttle",
    f"""{EVENTS}, g AS (SELECT *, lag(triggered_at) OVER w AS b FROM alert_event WINDOW w AS (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id)),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR triggered_at - b >= INTERVAL 10 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id) AS run FROM g),
n AS (SELECT *, row_number() OVER r - 1 AS suppressed_count, min(triggered_at) OVER (PARTITION BY pipeline, check_name, run) AS first_fired FROM i
  WINDOW r AS (PARTITION BY pipeline, check_name, run ORDER BY triggered_at, event_id))
SELECT event_id, suppressed_count, suppressed_count > 0 AND suppressed_count - 1 < 2 AS throttled, first_fired FROM n""",
)
def throttle(spark, folder):
    out = O.throttle(slim(spark, folder), 600, 2)
    return out.select("event_id", "suppressed_count", "throttled", "first_fired")


QUOTA_SQL = """f AS (SELECT pipeline, event_id, rn, [triggered_at] AS log, true AS allowed FROM e WHERE rn = 1
UNION ALL SELECT pipeline, event_id, rn, CASE WHEN len(kept) < {n} THEN list_append(kept, triggered_at) ELSE kept END, len(kept) < {n}
  FROM (SELECT e.*, list_filter(f.log, lambda x: x >= e.triggered_at - INTERVAL {w}) AS kept FROM f JOIN e ON e.pipeline = f.pipeline AND e.rn = f.rn + 1))
SELECT event_id, allowed, len(log)::BIGINT AS current_count FROM f"""


@query("quota", f"{WALK}, {BY_PIPELINE}, {QUOTA_SQL.format(n=3, w='12 HOUR')}")
def quota(spark, folder):
    return K.quota(slim(spark, folder), 3, 720).select("event_id", "allowed", "current_count")


@query("rate_limit", f"{WALK}, {BY_PIPELINE}, {QUOTA_SQL.format(n=5, w='86400 SECOND')}")
def rate_limit(spark, folder):
    return K.rate_limit(slim(spark, folder), 5, 86400).select("event_id", "allowed", "current_count")


@query(
    "backoff",
    f"""{WALK}, {BY_CHECK}, f AS (SELECT pipeline, check_name, event_id, rn, triggered_at AS last, 1 AS attempts, true AS due FROM e WHERE rn = 1
UNION ALL SELECT pipeline, check_name, event_id, rn, CASE WHEN d THEN triggered_at ELSE last END, attempts + d::INT, d
  FROM (SELECT e.*, f.last, f.attempts, f.attempts < 5 AND e.triggered_at >= f.last + to_seconds(least(7200 * pow(2, f.attempts), 172800)::BIGINT) AS d
    FROM f JOIN e ON e.pipeline = f.pipeline AND e.check_name = f.check_name AND e.rn = f.rn + 1))
SELECT event_id, due, attempts::BIGINT AS attempts FROM f""",
)
def backoff(spark, folder):
    return K.backoff(slim(spark, folder), 7200, 2, 172800, 5).select("event_id", "due", "attempts")


@query(
    "circuit_breaker",
    f"""{WALK}, {BY_PIPELINE}, f AS (SELECT pipeline, event_id, rn, 'closed' AS state, true AS allowed, (NOT passed)::BIGINT AS failures, NULL::TIMESTAMP AS opened FROM e WHERE rn = 1
UNION ALL SELECT pipeline, event_id, rn, st, st <> 'open', CASE WHEN st = 'open' THEN failures WHEN passed THEN 0 ELSE failures + 1 END,
    CASE WHEN st = 'open' THEN opened WHEN passed THEN NULL WHEN failures + 1 >= 2 THEN triggered_at END
  FROM (SELECT e.*, f.failures, f.opened, CASE WHEN f.opened IS NULL THEN 'closed' WHEN e.triggered_at - f.opened >= INTERVAL 3 HOUR THEN 'half_open' ELSE 'open' END AS st
    FROM f JOIN e ON e.pipeline = f.pipeline AND e.rn = f.rn + 1))
SELECT event_id, state, allowed, failures FROM f""",
)
def circuit_breaker(spark, folder):
    return K.circuit_breaker(slim(spark, folder), 2, 3 * 3600).select("event_id", "state", "allowed", "failures")


BATCH_SQL = """f AS (SELECT pipeline, event_id, triggered_at, rn, 0 AS batch_no, 1 AS size, triggered_at AS first, {n} <= 1 AS closes FROM e WHERE rn = 1
UNION ALL SELECT pipeline, event_id, triggered_at, rn, batch_no, size, first, size >= {n} OR triggered_at - first >= INTERVAL {w}
  FROM (SELECT e.*, f.batch_no + f.closes::INT AS batch_no, CASE WHEN f.closes THEN 1 ELSE f.size + 1 END AS size, CASE WHEN f.closes THEN e.triggered_at ELSE f.first END AS first
    FROM f JOIN e ON e.pipeline = f.pipeline AND e.rn = f.rn + 1))"""


@query("batch", f"{WALK}, {BY_PIPELINE}, {BATCH_SQL.format(n=5, w='6 HOUR')} SELECT event_id, batch_no::BIGINT AS batch_no, closes FROM f")
def batch(spark, folder):
    return K.batch(slim(spark, folder), 5, 6 * 3600).select("event_id", "batch_no", "closes")


@query(
    "buffer_flushes",
    f"""{WALK}, {BY_PIPELINE}, {BATCH_SQL.format(n=8, w='9 HOUR')} SELECT pipeline, batch_no::BIGINT AS batch_no, count(*) AS size, min(triggered_at) AS opened_at, max(triggered_at) AS last_at,
  CASE WHEN count(*) >= 8 THEN 'size' WHEN bool_or(closes) THEN 'age' ELSE 'manual' END AS reason FROM f GROUP BY ALL""",
)
def buffer_flushes(spark, folder):
    return K.batches(K.batch(slim(spark, folder), 8, 9 * 3600), 8)


@query(
    "buffer_by_size",
    f"""{EVENTS}, n AS (SELECT *, (row_number() OVER (PARTITION BY pipeline ORDER BY triggered_at, event_id) - 1) // 50 AS batch_no FROM alert_event)
SELECT pipeline, batch_no, count(*) AS size, min(triggered_at) AS opened_at, max(triggered_at) AS last_at, CASE WHEN count(*) >= 50 THEN 'size' ELSE 'manual' END AS reason FROM n GROUP BY ALL""",
)
def buffer_by_size(spark, folder):
    return K.batches(O.buffer_by_size(slim(spark, folder), 50), 50)


COMPACT_SQL = f"""{WALK}, {BY_CHECK}, f AS (SELECT pipeline, check_name, event_id, triggered_at, passed, rn, triggered_at AS last, passed AS ok, true AS keep FROM e WHERE rn = 1
UNION ALL SELECT pipeline, check_name, event_id, triggered_at, passed, rn, CASE WHEN d THEN last ELSE triggered_at END, CASE WHEN d THEN ok ELSE passed END, NOT d
  FROM (SELECT e.*, f.last, f.ok, e.passed AND f.ok AND e.triggered_at - f.last <= INTERVAL 8 HOUR AS d
    FROM f JOIN e ON e.pipeline = f.pipeline AND e.check_name = f.check_name AND e.rn = f.rn + 1)),
n AS (SELECT count(*) FILTER (NOT passed) AS bad FROM e),
r AS (SELECT event_id, pipeline, passed FROM f WHERE NOT passed
  UNION ALL SELECT event_id, pipeline, passed FROM (SELECT *, row_number() OVER (ORDER BY triggered_at DESC, event_id DESC) AS x FROM f WHERE keep AND passed), n WHERE x <= 2000 - bad)"""


def compacted(spark, folder):
    return K.compact(slim(spark, folder), 8 * 3600, 2000, order=("triggered_at", "event_id"))


@query("compaction", f"{COMPACT_SQL} SELECT event_id, pipeline, passed FROM r")
def compaction(spark, folder):
    return compacted(spark, folder).select("event_id", "pipeline", "passed")


@query(
    "compaction_stats",
    f"""{COMPACT_SQL}, c AS (SELECT (SELECT count(*) FROM e) AS original, (SELECT count(*) FROM r) AS retained)
SELECT original, retained, original - retained AS removed, round((original - retained) / original * 100, 2) AS reduction_pct FROM c""",
)
def compaction_stats(spark, folder):
    return K.compaction_stats(slim(spark, folder), compacted(spark, folder))


@query(
    "watermark_advance",
    """WITH e AS (SELECT event_id, 'p' || (user_id % 25) AS pipeline, ts, ts + to_hours((event_id * 7919) % 49) AS arrived FROM events),
m AS (SELECT *, max(ts) OVER w AS watermark FROM e WINDOW w AS (PARTITION BY pipeline ORDER BY arrived, event_id)),
l AS (SELECT *, lag(watermark) OVER (PARTITION BY pipeline ORDER BY arrived, event_id) AS b FROM m)
SELECT event_id, watermark, coalesce(ts <= b, false) AS late, greatest(0, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(watermark)) / 1000000.0::DOUBLE)::DOUBLE AS lag_seconds FROM l""",
)
def watermark_advance(spark, folder):
    arrived = F.expr("triggered_at + make_dt_interval(0, cast((event_id * 7919) % 49 as int))")
    e = slim(spark, folder).withColumn("arrived", arrived)
    out = O.watermark_advance(e, ["arrived", "event_id"], "triggered_at", AS_OF)
    return out.select("event_id", "watermark", "late", "lag_seconds")


WINDOW_SQL = """a AS (SELECT min(triggered_at) AS t0 FROM {source}),
b AS (SELECT t0 + to_seconds(i * {step}) AS start_at, t0 + to_seconds(i * {step} + {size}) AS end_at
  FROM a, LATERAL (SELECT unnest(range(0, 100000)) AS i) WHERE t0 + to_seconds(i * {step}) < TIMESTAMP '2024-01-31')
SELECT start_at, end_at, count(event_id) AS count, count(event_id) FILTER (severity <> 'info') AS failure_count,
  coalesce(string_agg(DISTINCT pipeline, ',' ORDER BY pipeline), '') AS pipelines
FROM b LEFT JOIN {source} e ON e.triggered_at >= start_at AND e.triggered_at < end_at GROUP BY ALL"""


def shown(windows):
    return windows.withColumn("pipelines", F.array_join("pipelines", ","))


@query("tumbling_windows", f"{EVENTS}, {WINDOW_SQL.format(source='alert_event', step=300, size=300)}")
def tumbling_windows(spark, folder):
    return shown(build_windows(slim(spark, folder), AS_OF, 300))


@query("sliding_windows", f"{EVENTS}, {WINDOW_SQL.format(source='alert_event', step=2700, size=7200)}")
def sliding_windows(spark, folder):
    return shown(build_windows(slim(spark, folder), AS_OF, 7200, 2700))


@query(
    "window_analyse",
    f"{EVENTS}, p AS (SELECT * FROM alert_event WHERE pipeline = 'p5'), {WINDOW_SQL.format(source='p', step=3600, size=3600)}",
)
def window_analyse(spark, folder):
    return shown(build_windows(slim(spark, folder), AS_OF, 3600, pipeline="p5"))


FLAGSHIP_RULES = [
    ("slow error", "error", "gt", 100.0, "critical"),
    ("large purchase", "purchase", "gte", 250.0, "warning"),
    ("tiny view", "view", "lt", 2.0, "info"),
]


@query(
    "flagship_health",
    f"""{WALK}, rule(rule_name, c, op, threshold, severity) AS (VALUES ('slow error', 'error', 'gt', 100.0, 'critical'),
  ('large purchase', 'purchase', 'gte', 250.0, 'warning'), ('tiny view', 'view', 'lt', 2.0, 'info')),
fired AS (SELECT e.event_id, e.pipeline, e.check_name, rule.rule_name, rule.severity, e.triggered_at FROM alert_event e JOIN rule ON check_name = c
  AND CASE op WHEN 'gt' THEN value > rule.threshold WHEN 'gte' THEN value >= rule.threshold ELSE value < rule.threshold END),
{MAINTENANCE_SQL},
open AS (SELECT * FROM fired e WHERE NOT {SILENCED} AND NOT EXISTS (SELECT 1 FROM w WHERE p = e.pipeline AND e.triggered_at BETWEEN start_at AND end_at)),
e AS (SELECT *, row_number() OVER (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id) AS rn FROM open),
f AS (SELECT *, triggered_at AS last FROM e WHERE rn = 1 UNION ALL SELECT e.*, CASE WHEN e.triggered_at >= f.last + INTERVAL 72 HOUR THEN e.triggered_at ELSE f.last END
  FROM f JOIN e ON e.pipeline = f.pipeline AND e.check_name = f.check_name AND e.rn = f.rn + 1),
k AS (SELECT * FROM f WHERE last = triggered_at), {HEALTH_SQL.format(source='k')}""",
)
def flagship_health(spark, folder):
    """Metric rules, silences, maintenance windows and de-duplication, then a health score."""
    rules = rule_table(
        spark, "name string, metric string, operator string, threshold double, severity string", FLAGSHIP_RULES
    ).withColumn("pipeline", F.lit(None).cast("string"))
    readings = D.alert_events(spark, folder).select(
        "event_id", "pipeline", F.col("check_name").alias("metric"), "value", F.struct("triggered_at", "event_id").alias("recorded_at")
    )
    fired = C.metric_alerts(readings, rules).select(
        F.col("recorded_at.event_id").alias("event_id"), "pipeline", F.col("metric").alias("check_name"),
        "rule_name", "severity", F.col("recorded_at.triggered_at").alias("triggered_at"),
    )
    left = R.in_maintenance(R.silence(fired, silence_rules(spark), AS_OF), maintenance(spark))
    kept = K.dedupe(left, 72 * 60).filter("fired")
    return health_score(kept).withColumn("deductions", F.array_join("deductions", ","))
