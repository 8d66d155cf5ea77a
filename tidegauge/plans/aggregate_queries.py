"""Groupings, scores, trends, digests, correlation, anomalies, forecasts, profiles, traces, pages, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import aggregates as A
from tidegauge.operators import graph as N
from tidegauge.operators import limits as L
from tidegauge.operators.checks import metric_alerts
from tidegauge.plans.check_queries import (
    METRIC_RULE_SCHEMA,
    METRIC_RULE_VALUES,
    METRIC_RULES,
    SPLIT_SQL,
)
from tidegauge.plans.filter_queries import CORRELATION_SQL
from tidegauge.plans.registry import query, rule_table
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import AS_OF, with_tables

EVENTS = with_tables("alert_event")
HISTORY = with_tables("history")


@query(
    "aggregate_recent",
    f"""{EVENTS}, r AS (SELECT * FROM alert_event WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 43200 SECOND ORDER BY triggered_at, event_id LIMIT 100)
SELECT check_name AS key, count(*) AS count, string_agg(event_id::VARCHAR, ',' ORDER BY triggered_at, event_id) AS event_ids,
  string_agg(severity, ',' ORDER BY triggered_at, event_id) AS severities FROM r GROUP BY 1""",
)
def aggregate_recent(spark, folder):
    out = A.aggregate_recent(D.alert_events(spark, folder), AS_OF, 43200, 100, "check")
    return out.select(
        "key", "count",
        F.array_join(F.transform("event_ids", lambda x: x.cast("string")), ",").alias("event_ids"),
        F.array_join("severities", ",").alias("severities"),
    )


@query(
    "group_events",
    f"""{EVENTS} SELECT pipeline AS key, count(*) AS count, CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END)
  WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS highest_severity FROM alert_event GROUP BY 1""",
)
def group_events(spark, folder):
    return A.group_events(D.alert_events(spark, folder))


@query(
    "partition_by",
    f"{EVENTS} SELECT severity AS partition, count(*) AS count, grouping(severity) = 1 AS is_total FROM alert_event GROUP BY ROLLUP (severity)",
)
def partition_by(spark, folder):
    return A.partition_counts(D.alert_events(spark, folder), "severity")


@query(
    "group_by_tag",
    f"""{EVENTS}, t AS (SELECT unnest(CASE WHEN passed THEN tags ELSE ['(untagged)'] END) AS tag FROM alert_event)
SELECT tag, count(*) AS count FROM t GROUP BY 1""",
)
def group_by_tag(spark, folder):
    e = D.alert_events(spark, folder)
    return A.group_by_tag(e.withColumn("tags", F.when(F.col("passed"), F.col("tags"))))


@query(
    "fingerprint_counts",
    f"""{EVENTS} SELECT pipeline, check_name, severity, count(*) AS occurrences, min(triggered_at) AS first_seen,
  sha256('{{"check": "' || check_name || '", "pipeline": "' || pipeline || '", "severity": "' || severity || '"}}') AS digest
FROM alert_event GROUP BY ALL""",
)
def fingerprint_counts(spark, folder):
    return A.fingerprint_counts(D.alert_events(spark, folder))


HEALTH_SQL = """weighted AS (SELECT pipeline, rule_name, CASE severity WHEN 'critical' THEN 40 WHEN 'warning' THEN 15 ELSE 5 END AS w FROM {source}),
r AS (SELECT pipeline, rule_name, w, count(*) AS n FROM weighted GROUP BY ALL),
s AS (SELECT pipeline, sum(n)::BIGINT AS event_count, greatest(0, 100 - sum(w * n))::BIGINT AS score,
  string_agg(rule_name || '(-' || w || ') x' || n, ',' ORDER BY rule_name || '(-' || w || ') x' || n) AS deductions FROM r GROUP BY 1)
SELECT pipeline, score, 100::BIGINT AS max_score, event_count, deductions, score > 50 AS healthy, round(score / 100 * 100, 1) AS pct FROM s"""


@query(
    "health_score",
    f"""{EVENTS}, {HEALTH_SQL.format(source='alert_event')}""",
)
def health_score(spark, folder):
    return A.health_score(D.alert_events(spark, folder)).withColumn("deductions", F.array_join("deductions", ","))


@query(
    "trend",
    f"""{HISTORY}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY recorded_at DESC, run_id DESC) AS rn FROM history),
t AS (SELECT * FROM r WHERE rn <= 20)
SELECT pipeline, count(*) AS total_runs, count(*) FILTER (status = 'PASS') AS passed_runs, count(*) FILTER (status <> 'PASS') AS failed_runs,
  count(*) FILTER (status = 'PASS') / count(*) AS pass_rate, coalesce(min(rn) FILTER (status <> 'FAIL') - 1, count(*)) AS consecutive_failures,
  min_by(status, rn) AS last_status FROM t GROUP BY 1""",
)
def trend(spark, folder):
    return A.trend(D.history(spark, folder), 20)


DIGEST_SQL = f"""{EVENTS}, p AS (SELECT * FROM alert_event WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR),
lp AS (SELECT pipeline, max((triggered_at, event_id)) FILTER (passed) AS lp FROM p GROUP BY 1),
d AS (SELECT pipeline, count(*) AS total_runs, count(*) FILTER (passed) AS passed_runs, count(*) FILTER (NOT passed) AS failed_runs,
  count(*) FILTER (passed) / count(*) AS pass_rate, max(triggered_at) AS last_run_at,
  count(*) FILTER (lp IS NULL OR (triggered_at, event_id) > lp) AS consecutive_failures FROM p JOIN lp USING (pipeline) GROUP BY 1)"""


def digest_of(spark, folder):
    e = D.alert_events(spark, folder).withColumnRenamed("triggered_at", "recorded_at")
    return A.digest(e, AS_OF, 72, ("recorded_at", "event_id"), "event_id")


@query("digest", f"{DIGEST_SQL} SELECT *, CASE WHEN consecutive_failures = 0 THEN 'OK' ELSE 'DEGRADED' END AS status FROM d")
def digest(spark, folder):
    return digest_of(spark, folder)


@query(
    "digest_totals",
    f"""{DIGEST_SQL} SELECT count(*) AS pipelines, count(*) FILTER (consecutive_failures = 0) AS healthy,
  count(*) FILTER (consecutive_failures > 0) AS degraded FROM d""",
)
def digest_totals(spark, folder):
    return A.digest_totals(digest_of(spark, folder))


EVENT_RUNS = f"{EVENTS}, h AS (SELECT pipeline, passed, triggered_at AS recorded_at, event_id AS run_id FROM alert_event)"


@query("correlation", f"{EVENT_RUNS}, {CORRELATION_SQL.format(source='h', limit=50)} SELECT * FROM pairs")
def correlation(spark, folder):
    return A.correlate(D.alert_events(spark, folder), 50, order=("triggered_at", "event_id"))


@query("correlation_long", f"{EVENT_RUNS}, {CORRELATION_SQL.format(source='h', limit=200)} SELECT * FROM pairs")
def correlation_long(spark, folder):
    return A.correlate(D.alert_events(spark, folder), 200, order=("triggered_at", "event_id"))


@query(
    "correlation_overall",
    f"""{HISTORY}, n AS (SELECT * FROM history ORDER BY recorded_at DESC, run_id DESC LIMIT 50), {CORRELATION_SQL.format(source='n', limit=50)} SELECT * FROM pairs""",
)
def correlation_overall(spark, folder):
    return A.correlate(D.history(spark, folder), 50, overall=True)


@query(
    "rank_pairs",
    f"""{EVENT_RUNS}, {CORRELATION_SQL.format(source='h', limit=50)}
SELECT * FROM pairs ORDER BY abs(score) DESC, pipeline_a, pipeline_b""",
)
def rank_pairs(spark, folder):
    pairs = A.correlate(D.alert_events(spark, folder), 50, order=("triggered_at", "event_id"))
    return L.rank_pairs(pairs)


@query(
    "anomaly",
    f"""{SPLIT_SQL}, u AS (SELECT pipeline, metric, max(recorded_at) AS until FROM metric GROUP BY ALL),
h AS (SELECT pipeline, metric, avg(value) AS mean, stddev_pop(value) AS sd FROM metric JOIN u USING (pipeline, metric) WHERE recorded_at < until GROUP BY ALL)
SELECT pipeline, metric, v AS value, round(mean, 6) AS mean, round(sd, 6) AS stddev, round(abs(v - mean) / sd, 6) AS z_score,
  abs(v - mean) / sd > 1.5 AS is_anomaly FROM cur JOIN h USING (pipeline, metric)""",
)
def anomaly(spark, folder):
    out = A.newest_anomalies(D.metrics(spark, folder), 1.5)
    return out.select("pipeline", "metric", "value", *[F.round(c, 6).alias(c) for c in ("mean", "stddev", "z_score")], "is_anomaly")


@query(
    "anomaly_rolling",
    f"""{with_tables('metric')}, w AS (SELECT *, count(*) OVER f AS n, avg(value) OVER f AS m, stddev_pop(value) OVER f AS sd FROM metric
  WINDOW f AS (PARTITION BY pipeline, metric ORDER BY recorded_at ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
SELECT pipeline, metric, recorded_at, value, round(coalesce(m, value), 6) AS mean,
  round(CASE WHEN n >= 2 AND sd > 1e-9 THEN abs(value - m) / sd ELSE 0 END, 5)::DOUBLE AS z_score FROM w""",
)
def anomaly_rolling(spark, folder):
    out = A.rolling_anomalies(D.metrics(spark, folder), 30)
    z = F.when(F.col("stddev") > 1e-9, F.col("z_score")).otherwise(0.0)
    return out.select("pipeline", "metric", "recorded_at", "value", F.round("mean", 6).alias("mean"), F.round(z, 5).alias("z_score"))


LINE_SQL = """l AS (SELECT pipeline, metric, count(*) AS points, avg(x) AS mx, avg(value) AS my, max(x) AS lx,
  coalesce(regr_slope(value, x), 0) AS slope, regr_r2(value, x) AS r2, var_pop(value) AS vy
  FROM (SELECT *, epoch_us(recorded_at) / 3600000000.0::DOUBLE - 200000 AS x FROM {source}) GROUP BY ALL)"""


@query(
    "forecast",
    f"""{with_tables('metric')}, m AS (SELECT * REPLACE (CASE WHEN pipeline = 'A' AND recorded_at < TIMESTAMP '1995-01-06' THEN 'A first' ELSE pipeline END AS pipeline) FROM metric),
{LINE_SQL.format(source='m')}
SELECT pipeline, metric, points, CASE WHEN points < 5 THEN 'NaN'::DOUBLE ELSE round(my + slope * (lx + 24 - mx), 4) END AS predicted_value,
  CASE WHEN points < 5 THEN 0.0::DOUBLE ELSE round(least(1, greatest(0, CASE WHEN vy = 0 THEN 1 ELSE coalesce(r2, 0) END)), 4)::DOUBLE END AS confidence,
  CASE WHEN points < 5 THEN 'insufficient history (' || points || '/5 points)' END AS warning FROM l""",
)
def forecast(spark, folder):
    # The first days of one pipeline are a series of their own, too short to forecast.
    first = (F.col("pipeline") == "A") & (F.col("recorded_at") < F.expr("timestamp_ntz'1995-01-06 00:00:00'"))
    m = D.metrics(spark, folder).withColumn("pipeline", F.when(first, "A first").otherwise(F.col("pipeline")))
    out = A.forecast(m, 24, 5)
    return out.withColumn("predicted_value", F.round("predicted_value", 4))


@query(
    "projection",
    f"""{with_tables('metric')}, {LINE_SQL.format(source='metric')}
SELECT pipeline, metric, round(my + slope * (lx + 48 - mx), 4) AS projected_value,
  round(least(1, greatest(0, CASE WHEN vy = 0 THEN 1 ELSE coalesce(r2, 0) END)), 6)::DOUBLE AS confidence, points AS based_on FROM l WHERE points >= 2""",
)
def projection(spark, folder):
    out = A.project(D.metrics(spark, folder), 48)
    return out.withColumn("projected_value", F.round("projected_value", 4)).withColumn("confidence", F.round("confidence", 6))


@query(
    "profile_report",
    f"""{with_tables('profile_sample')}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline, check_name ORDER BY duration_ms, sample_id) AS rn,
  count(*) OVER (PARTITION BY pipeline, check_name) AS n FROM profile_sample)
SELECT pipeline, check_name, count(*) AS count, round(avg(duration_ms), 4) AS mean_ms, max(duration_ms) FILTER (rn = greatest(1, floor(n * 0.95::DOUBLE))) AS p95_ms,
  round(stddev_samp(duration_ms), 4) AS stdev_ms FROM r GROUP BY ALL""",
)
def profile_report(spark, folder):
    out = A.profile_report(D.profile_samples(spark, folder))
    return out.withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("stdev_ms", F.round("stdev_ms", 4))


@query(
    "shadow_summary",
    f"""{with_tables('metric')}, rule(rule_idx, rule_name, p, m, operator, threshold, severity) AS (VALUES {METRIC_RULE_VALUES})
SELECT pipeline, count(*) AS evaluated, count(*) AS would_alert FROM metric JOIN rule
ON metric = m AND (p IS NULL OR p = pipeline) AND CASE operator WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold
  WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold WHEN 'eq' THEN value = threshold ELSE false END GROUP BY 1""",
)
def shadow_summary(spark, folder):
    rules = rule_table(spark, METRIC_RULE_SCHEMA, METRIC_RULES)
    return A.shadow_summary(metric_alerts(D.metrics(spark, folder), rules))


@query(
    "trace_rollup",
    f"""{with_tables('span')}, d AS (SELECT *, round((epoch_us(ended_at) - epoch_us(started_at)) / 1000.0::DOUBLE, 3) AS ms FROM span)
SELECT trace_id, count(*) AS spans, count(*) FILTER (status = 'error') AS failed_spans, count(*) FILTER (ended_at IS NULL) AS open_spans,
  min_by(span_id, started_at) FILTER (parent_span_id IS NULL) AS root_span, min_by(ms, started_at) FILTER (parent_span_id IS NULL AND ms IS NOT NULL) AS root_ms FROM d GROUP BY 1""",
)
def trace_rollup(spark, folder):
    return A.trace_rollup(D.spans(spark, folder))


@query(
    "span_durations",
    f"""{with_tables('span')} SELECT trace_id, span_id, round((epoch_us(ended_at) - epoch_us(started_at)) / 1000.0::DOUBLE, 3) AS duration_ms FROM span""",
)
def span_durations(spark, folder):
    return A.span_durations(D.spans(spark, folder)).select("trace_id", "span_id", "duration_ms")


@query(
    "usage",
    f"""{EVENTS} SELECT pipeline, count(*) AS usage FROM alert_event WHERE triggered_at >= TIMESTAMP '2024-01-31' - INTERVAL 1500 MINUTE GROUP BY 1""",
)
def usage(spark, folder):
    return A.usage(D.alert_events(spark, folder), AS_OF, 1500)


@query(
    "recent",
    f"""{EVENTS} SELECT event_id, pipeline, triggered_at FROM alert_event WHERE pipeline = 'p3' ORDER BY triggered_at DESC, event_id DESC LIMIT 50""",
)
def recent(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "triggered_at")
    return L.recent(e, ["triggered_at", "event_id"], 50, "p3")


@query(
    "paginate",
    f"""{EVENTS} SELECT event_id, pipeline, triggered_at FROM alert_event ORDER BY triggered_at, event_id LIMIT 40 OFFSET 80""",
)
def paginate(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "triggered_at")
    return L.page(e, ["triggered_at", "event_id"], 3, 40)


@query(
    "paginate_deep",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100
OFFSET (SELECT (count(*) * 9 // 1000) * 100 FROM orders)""",
)
def paginate_deep(spark, folder):
    """A page near the end, by an index of ranks."""
    o = D.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return L.page(o, ["o_totalprice", "o_orderkey"], o.count() * 9 // 1000 + 1, 100, deep_rows=100)


@query(
    "paginate_after",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) > (250000.0, 17) ORDER BY o_totalprice, o_orderkey LIMIT 100""",
)
def paginate_after(spark, folder):
    o = D.table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return L.page_after(o, ["o_totalprice", "o_orderkey"], [250000.0, 17], 100)


@query(
    "page_info",
    """SELECT 3 AS page, 40 AS page_size, count(*) AS total, greatest(1, ceil(count(*) / 40))::BIGINT AS total_pages,
  3 < ceil(count(*) / 40) AS has_next, true AS has_prev FROM events""",
)
def page_info(spark, folder):
    return L.page_info(D.table(spark, folder, "events"), 3, 40)


EDGES = with_tables("edge")


@query(
    "neighbours",
    f"""{EDGES} SELECT 'up' AS side, upstream AS pipeline FROM edge WHERE downstream = 'n03'
UNION ALL SELECT 'down', downstream FROM edge WHERE upstream = 'n03'""",
)
def neighbours(spark, folder):
    e = D.edges(spark, folder)
    up = N.upstream_of(e, "n03").withColumn("side", F.lit("up"))
    return up.unionByName(N.downstream_of(e, "n03").withColumn("side", F.lit("down")))


@query(
    "degrees",
    f"""{EDGES}, n AS (SELECT upstream AS pipeline, 0 AS i, 1 AS o FROM edge UNION ALL SELECT downstream, 1, 0 FROM edge)
SELECT pipeline, sum(i)::BIGINT AS upstream_count, sum(o)::BIGINT AS downstream_count FROM n GROUP BY 1""",
)
def degrees(spark, folder):
    return N.degrees(D.edges(spark, folder, acyclic=False))


@query("all_pipelines", f"{EDGES} SELECT upstream AS pipeline FROM edge UNION SELECT downstream FROM edge")
def all_pipelines(spark, folder):
    return N.all_pipelines(D.edges(spark, folder))


@query(
    "has_cycle",
    f"""{with_tables('edge', recursive=True)}, reach(a, b) AS (SELECT upstream, downstream FROM edge
  UNION SELECT a, downstream FROM reach JOIN edge ON b = upstream) SELECT bool_or(a = b) AS has_cycle FROM reach""",
)
def has_cycle(spark, folder):
    return N.has_cycle(D.edges(spark, folder))


@query(
    "has_cycle_acyclic",
    f"""{with_tables('edge', recursive=True)}, e AS (SELECT * FROM edge WHERE upstream < downstream),
reach(a, b) AS (SELECT upstream, downstream FROM e UNION SELECT a, downstream FROM reach JOIN e ON b = upstream)
SELECT bool_or(a = b) AS has_cycle FROM reach""",
)
def has_cycle_acyclic(spark, folder):
    return N.has_cycle(D.edges(spark, folder, acyclic=True))
