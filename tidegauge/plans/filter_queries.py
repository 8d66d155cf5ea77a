"""Filters, silencing, maintenance, routing, sampling, retention, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import filters as R
from tidegauge.operators.aggregates import correlate, strong_pairs as keep_strong
from tidegauge.plans.registry import query, rule_table
from tidegauge.sources import stores as S
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import AS_OF, with_tables

EVENTS = with_tables("alert_event")


def chain(spark, folder):
    rules = [
        ("not info", F.col("severity") != "info", "include"),
        ("no purchases of p1", (F.col("pipeline") == "p1") & (F.col("check_name") == "purchase"), "exclude"),
        ("large", F.col("value") > 20, "include"),
    ]
    return R.filter_chain(D.alert_events(spark, folder), rules)


CHAIN_SQL = "(severity <> 'info' AND value > 20 AND NOT (pipeline = 'p1' AND check_name = 'purchase'))"


@query("filter_chain", f"{EVENTS} SELECT event_id, pipeline, value, {CHAIN_SQL} AS kept FROM alert_event")
def filter_chain(spark, folder):
    return chain(spark, folder).select("event_id", "pipeline", "value", "kept")


@query(
    "filter_acceptance",
    f"""{EVENTS} SELECT count(*) FILTER {CHAIN_SQL.replace('(severity', '(WHERE (severity', 1)}) AS accepted,
  count(*) FILTER (WHERE NOT {CHAIN_SQL}) AS rejected, avg({CHAIN_SQL}::INT)::DOUBLE AS rate FROM alert_event""",
)
def filter_acceptance(spark, folder):
    return R.acceptance(chain(spark, folder))


@query(
    "complement_split",
    f"""{EVENTS} SELECT 'rejected' AS side, pipeline, count(*) AS n FROM alert_event WHERE NOT {CHAIN_SQL} GROUP BY ALL
UNION ALL SELECT 'accepted', pipeline, count(*) FROM alert_event WHERE {CHAIN_SQL} GROUP BY ALL""",
)
def complement_split(spark, folder):
    yes, no = R.split(chain(spark, folder), F.col("kept"))
    count = lambda d, side: d.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    return count(yes, "accepted").unionByName(count(no, "rejected"))


@query(
    "tag_filter",
    f"""{EVENTS} SELECT event_id, check_name FROM alert_event
WHERE list_has_any(tags, ['error', 'k1', 'k2']) AND NOT list_has_any(tags, ['click', 'k3'])""",
)
def tag_filter(spark, folder):
    e = D.alert_events(spark, folder)
    return R.tag_filter(e, ["error", "k1", "k2"], ["click", "k3"]).select("event_id", "check_name")


@query(
    "tag_overlap",
    f"""{EVENTS} SELECT event_id, len(list_intersect(tags, ['error', 'k1', 'view']))::BIGINT AS common,
  list_has_any(tags, ['error', 'k1', 'view']) AS overlaps FROM alert_event""",
)
def tag_overlap(spark, folder):
    want = ["error", "k1", "view"]
    return D.alert_events(spark, folder).select(
        "event_id",
        F.size(R.common_tags("tags", want)).cast("bigint").alias("common"),
        R.tag_match("tags", want).alias("overlaps"),
    )


SILENCES = [
    (1, "p1*", "click", "noise", None),
    (2, "p[2-4]", "err?r", "known", "2024-02-01 00:00:00"),
    (3, "*", "view", "expired", "2024-01-01 00:00:00"),
    (4, "p[!0-7]", "*", "new", "2024-03-01 00:00:00"),
]


def silence_rules(spark):
    r = rule_table(
        spark, "rule_idx int, pipeline_glob string, check_glob string, reason string, e string", SILENCES
    )
    return r.withColumn("expires_at", F.try_to_timestamp("e").cast("timestamp_ntz")).drop("e")


SILENCED = """((pipeline LIKE 'p1%' AND check_name = 'click') OR (pipeline IN ('p2', 'p3', 'p4') AND check_name LIKE 'err_r')
  OR pipeline IN ('p8', 'p9'))"""


@query("silence", f"{EVENTS} SELECT event_id, pipeline, check_name FROM alert_event WHERE NOT {SILENCED}")
def silence(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "check_name")
    return R.silence(e, silence_rules(spark), AS_OF)


@query(
    "active_silences",
    """SELECT o_orderkey AS rule_idx FROM orders WHERE o_orderstatus = 'P' OR TIMESTAMP '1998-06-01' < o_orderdate""",
)
def active_silences(spark, folder):
    expires = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    rules = D.table(spark, folder, "orders").select(F.col("o_orderkey").alias("rule_idx"), expires.alias("expires_at"))
    return R.active_silences(rules, "1998-06-01 00:00:00").select("rule_idx")


MAINTENANCE = [
    ("p1", "2024-01-05 00:00:00", "2024-01-09 12:00:00", "move"),
    ("p1", "2024-01-08 00:00:00", "2024-01-10 00:00:00", "move again"),
    ("p7", "2024-01-20 00:00:00", "2024-02-20 00:00:00", "rebuild"),
]
MAINTENANCE_SQL = """w(p, start_at, end_at, reason) AS (VALUES
  ('p1', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-09 12:00:00', 'move'),
  ('p1', TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-10 00:00:00', 'move again'),
  ('p7', TIMESTAMP '2024-01-20 00:00:00', TIMESTAMP '2024-02-20 00:00:00', 'rebuild'))"""


def maintenance(spark):
    r = rule_table(spark, "pipeline string, s string, e string, reason string", MAINTENANCE)
    ts = lambda c: F.to_timestamp_ntz(F.col(c))
    return r.select("pipeline", ts("s").alias("start_at"), ts("e").alias("end_at"), "reason")


@query(
    "suppress_windows",
    f"""{EVENTS}, {MAINTENANCE_SQL} SELECT event_id, pipeline FROM alert_event e
WHERE NOT EXISTS (SELECT 1 FROM w WHERE p = e.pipeline AND e.triggered_at BETWEEN start_at AND end_at)""",
)
def suppress_windows(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "triggered_at")
    return R.in_maintenance(e, maintenance(spark)).select("event_id", "pipeline")


@query(
    "window_status",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_shipdate AS s, l_shipdate + to_days(l_quantity::INT) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, TIMESTAMP '1998-06-01' BETWEEN s AND e AS active, e < TIMESTAMP '1998-06-01' AS expired FROM w""",
)
def window_status(spark, folder):
    w = D.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("start_at"),
        F.expr("l_shipdate + make_dt_interval(cast(l_quantity as int))").alias("end_at"),
    )
    return R.window_status(w, "1998-06-01 00:00:00").drop("start_at", "end_at")


ROUTES = [
    (1, "p1", None, [], "team-one"),
    (2, None, "critical", [], "pager"),
    (3, "p2", "warning", ["k1", "k2"], "team-two"),
    (4, "", None, ["k4", "view"], "dashboard"),
]


@query(
    "route",
    f"""{EVENTS}, rule(rule_idx, p, s, t, channel) AS (VALUES (1, 'p1', NULL, []::VARCHAR[], 'team-one'), (2, NULL, 'critical', [], 'pager'),
  (3, 'p2', 'warning', ['k1', 'k2'], 'team-two'), (4, NULL, NULL, ['k4', 'view'], 'dashboard'))
SELECT event_id, coalesce(string_agg(channel, ',' ORDER BY rule_idx), 'default') AS channels FROM alert_event LEFT JOIN rule
ON (p IS NULL OR p = pipeline) AND (s IS NULL OR s = severity) AND (len(t) = 0 OR list_has_any(t, tags)) GROUP BY event_id""",
)
def route(spark, folder):
    schema = "rule_idx int, pipeline string, severity string, tags array<string>, channel string"
    out = R.route(D.alert_events(spark, folder), rule_table(spark, schema, ROUTES))
    return out.select("event_id", F.array_join("channels", ",").alias("channels"))


@query(
    "shed",
    f"""{EVENTS}, d AS (SELECT *, count(*) OVER (PARTITION BY date_trunc('hour', triggered_at)) AS depth FROM alert_event)
SELECT event_id, depth AS queue_depth, depth >= 15 AND CASE severity WHEN 'critical' THEN 10 WHEN 'warning' THEN 5 WHEN 'info' THEN 1 ELSE 0 END < 5 AS shed FROM d""",
)
def shed(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "severity", "triggered_at")
    deep = R.backlog_depth(e, F.date_trunc("hour", "triggered_at"))
    return R.shed(deep, max_queue_depth=15, min_priority=5).select("event_id", "queue_depth", "shed")


@query(
    "sample",
    """SELECT event_id, ('0x' || substr(md5(event_id || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.3 AS sampled FROM events""",
)
def sample(spark, folder):
    return R.sample(D.table(spark, folder, "events"), 0.3, "event_id", seed=42).select("event_id", "sampled")


@query(
    "replay",
    f"""{with_tables('history')} SELECT count(*) AS total, count(*) FILTER (NOT passed) AS failures,
  count(*) FILTER (passed) / count(*) AS pass_rate FROM history
WHERE pipeline = '2-HIGH' AND recorded_at BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30'""",
)
def replay(spark, folder):
    return R.replay(D.history(spark, folder), "2-HIGH", "1996-01-01 00:00:00", "1998-06-30 00:00:00")


def queue(spark, folder):
    e = D.alert_events(spark, folder)
    queued = S.enqueue_failures(e, F.col("triggered_at"))
    tries = (
        e.filter("not passed")
        .select("event_id", "triggered_at", F.explode(F.sequence(F.lit(0), F.col("event_id") % 5)).alias("i"))
        .filter("i > 0")
        .select("event_id", F.expr("triggered_at + make_dt_interval(0, i, 0, 0)").alias("attempted_at"))
    )
    return S.apply_attempts(queued, tries)


@query(
    "requeue_pending",
    f"{EVENTS} SELECT event_id, event_id % 5 AS attempts FROM alert_event WHERE NOT passed AND event_id % 5 < 3",
)
def requeue_pending(spark, folder):
    return R.pending_requeue(queue(spark, folder)).select("event_id", "attempts")


RETAIN_FROM = "TIMESTAMP '1999-01-01' - INTERVAL 20000 HOUR"


@query(
    "retention",
    f"""{with_tables('history')} SELECT run_id, pipeline, recorded_at FROM history WHERE recorded_at >= {RETAIN_FROM}
ORDER BY recorded_at DESC, run_id DESC LIMIT 700""",
)
def retention(spark, folder):
    h = D.history(spark, folder).select("run_id", "pipeline", "recorded_at")
    return R.retain(h, "1999-01-01 00:00:00", 20000, 700)


@query(
    "retention_counts",
    f"""{with_tables('history')}, c AS (SELECT count(*) AS n, count(*) FILTER (recorded_at >= {RETAIN_FROM}) AS y FROM history)
SELECT n - y AS removed_by_age, greatest(y - 700, 0) AS removed_by_cap, least(y, 700) AS remaining FROM c""",
)
def retention_counts(spark, folder):
    return R.retention_counts(D.history(spark, folder), "1999-01-01 00:00:00", 20000, 700)


@query(
    "archive_split",
    """WITH t AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'not a time' WHEN event_id % 13 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS s FROM events)
SELECT event_id, coalesce(try_cast(s AS TIMESTAMP), TIMESTAMP '1970-01-01') < TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR AS archived FROM t""",
)
def archive_split(spark, folder):
    text = (
        F.when(F.col("event_id") % 11 == 0, "not a time")
        .when(F.col("event_id") % 13 == 0, F.lit(None))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    )
    e = D.table(spark, folder, "events").select("event_id", text.alias("at"))
    return R.archive_flag(e, "at", AS_OF).select("event_id", "archived")


CORRELATION_SQL = """ranked AS (SELECT pipeline, passed::INT AS x, row_number() OVER (PARTITION BY pipeline ORDER BY recorded_at DESC, run_id DESC) AS rn FROM {source}),
s AS (SELECT * FROM ranked WHERE rn <= {limit}),
c AS (SELECT a.pipeline AS pipeline_a, b.pipeline AS pipeline_b, count(*) AS n, sum(a.x) AS sx, sum(b.x) AS sy, sum(a.x * b.x) AS sxy
  FROM s a JOIN s b ON a.rn = b.rn AND a.pipeline < b.pipeline GROUP BY ALL HAVING count(*) >= 2),
pairs AS (SELECT pipeline_a, pipeline_b, CASE WHEN (n * sx - sx * sx) * (n * sy - sy * sy) = 0 THEN 0.0::DOUBLE
  ELSE round((n * sxy - sx * sy) / sqrt(((n * sx - sx * sx) * (n * sy - sy * sy))::DOUBLE), 4) END AS score, n AS sample_size FROM c)"""


@query(
    "strong_pairs",
    f"""{EVENTS}, h AS (SELECT pipeline, passed, triggered_at AS recorded_at, event_id AS run_id FROM alert_event),
{CORRELATION_SQL.format(source='h', limit=50)} SELECT * FROM pairs WHERE abs(score) >= 0.3""",
)
def strong_pairs(spark, folder):
    pairs = correlate(D.alert_events(spark, folder), 50, order=("triggered_at", "event_id"))
    return keep_strong(pairs, 0.3)


@query(
    "latest_valid",
    f"""{EVENTS}, l AS (SELECT pipeline, check_name, max_by(event_id, (triggered_at, event_id)) AS event_id,
  max_by(status, (triggered_at, event_id)) AS status, max_by(value, (triggered_at, event_id)) AS value, max(triggered_at) AS cached_at FROM alert_event GROUP BY ALL)
SELECT *, cached_at + INTERVAL 6 HOUR AS expires_at FROM l WHERE TIMESTAMP '2024-01-31' < cached_at + INTERVAL 6 HOUR""",
)
def latest_valid(spark, folder):
    return R.latest_valid(D.alert_events(spark, folder), AS_OF, 6 * 3600)


SCHEDULES = [
    ("hourly", "p1", "@hourly"),
    ("mondays", "p2", "*/20 3-5 * * 0"),
    ("new year", "p3", "30 12 1 1 *"),
    ("weekly", "p4", "@weekly"),
]


DUE_SQL = """m AS (SELECT TIMESTAMP '2024-01-01' + to_minutes(i) AS t FROM range(0, 30 * 1440 + 1) r(i)),
due AS (SELECT 'hourly' AS name, 'p1' AS pipeline, t FROM m WHERE minute(t) = 0
 UNION ALL SELECT 'mondays', 'p2', t FROM m WHERE minute(t) % 20 = 0 AND hour(t) BETWEEN 3 AND 5 AND isodow(t) = 1
 UNION ALL SELECT 'new year', 'p3', t FROM m WHERE minute(t) = 30 AND hour(t) = 12 AND day(t) = 1 AND month(t) = 1
 UNION ALL SELECT 'weekly', 'p4', t FROM m WHERE minute(t) = 0 AND hour(t) = 0 AND isodow(t) = 1)"""


@query(
    "schedule_missed_runs",
    f"""{EVENTS}, {DUE_SQL}
SELECT name, pipeline, t AS due_at FROM due WHERE NOT EXISTS (SELECT 1 FROM alert_event e WHERE e.pipeline = due.pipeline AND date_trunc('minute', triggered_at) = t)""",
)
def schedule_missed_runs(spark, folder):
    s = rule_table(spark, "name string, pipeline string, expression string", SCHEDULES)
    due = R.due_minutes(s, "2024-01-01 00:00:00", AS_OF)
    return R.missed_runs(due, D.alert_events(spark, folder), "2024-01-01 00:00:00", AS_OF).select("name", "pipeline", "due_at")


@query(
    "schedule_runs_per_due_hour",
    f"""{EVENTS}, {DUE_SQL}, n AS (SELECT pipeline, date_trunc('hour', triggered_at) AS h, count(*) AS n FROM alert_event GROUP BY ALL)
SELECT name, t AS due_at, coalesce(n, 0) AS runs FROM due LEFT JOIN n ON n.pipeline = due.pipeline AND h = date_trunc('hour', t)""",
)
def schedule_runs_per_due_hour(spark, folder):
    """Runs in the hour of each due minute of every schedule."""
    s = rule_table(spark, "name string, pipeline string, expression string", SCHEDULES)
    due = R.due_minutes(s, "2024-01-01 00:00:00", AS_OF)
    hour = F.date_trunc("hour", "triggered_at").cast("timestamp_ntz")
    runs = D.alert_events(spark, folder).groupBy("pipeline", hour.alias("_hour")).agg(F.count(F.lit(1)).alias("n"))
    due = due.withColumn("_hour", F.date_trunc("hour", "due_at").cast("timestamp_ntz"))
    return due.join(runs, ["pipeline", "_hour"], "left").select("name", "due_at", F.coalesce("n", F.lit(0)).alias("runs"))
