"""Rule, history, audit, checkpoint, baseline, snapshot, requeue, delivery and outbox tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder
from tidegauge.operators import checks as C
from tidegauge.operators import filters as R
from tidegauge.operators.limits import recent
from tidegauge.plans.registry import query
from tidegauge.sources import stores as S
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import with_tables

EVENTS = with_tables("alert_event")


@query(
    "read_rules",
    """SELECT p_partkey AS rule_idx, p_brand AS name, p_type AS metric, CASE p_size % 5 WHEN 0 THEN 'gt' WHEN 1 THEN 'lt' WHEN 2 THEN 'gte' WHEN 3 THEN 'lte' ELSE 'eq' END AS operator,
  p_size::DOUBLE AS threshold, CASE WHEN p_size % 3 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM part""",
)
def read_rules(spark, folder):
    p = D.table(spark, folder, "part")
    ops = F.element_at(F.array(*[F.lit(o) for o in ("gt", "lt", "gte", "lte", "eq")]), F.col("p_size") % 5 + 1)
    rules = p.select(
        F.col("p_partkey").alias("rule_idx"),
        F.col("p_brand").alias("name"),
        F.col("p_type").alias("metric"),
        ops.alias("operator"),
        F.col("p_size").alias("threshold"),
        F.when(F.col("p_size") % 3 == 0, "critical").alias("severity"),
    )
    return C.check_rules(rules)


@query(
    "history_store",
    f"""{with_tables('history')} SELECT run_id, pipeline, passed, recorded_at FROM history WHERE recorded_at >= TIMESTAMP '1997-01-01' ORDER BY recorded_at DESC, run_id DESC LIMIT 200""",
)
def history_store(spark, folder):
    """Append the history, a folder per month, in two parts; read back the newest runs of a period."""
    path = work_folder(spark, "history")
    h = D.history(spark, folder).select("run_id", "pipeline", "passed", "recorded_at")
    cut = F.expr("timestamp_ntz'1996-01-01 00:00:00'")
    for part in R.split(h, F.col("recorded_at") < cut):
        S.append_history(part, path)
    back = spark.read.parquet(path).filter("month >= date'1997-01-01' and recorded_at >= timestamp_ntz'1997-01-01 00:00:00'")
    return recent(back.drop("month"), ["recorded_at", "run_id"], 200)


@query(
    "read_history",
    f"""{with_tables('history')} SELECT run_id::VARCHAR AS run_id, pipeline, passed, recorded_at FROM history""",
)
def read_history(spark, folder):
    """JSON array files of up to a thousand runs, read as one history; a missing file adds nothing."""
    path = work_folder(spark, "history-json")
    h = D.history(spark, folder).select(F.col("run_id").cast("string").alias("run_id"), "pipeline", "passed", "recorded_at")
    array = F.to_json(F.collect_list(F.struct("run_id", "pipeline", "passed", "recorded_at")))
    files = h.groupBy(F.floor(F.col("run_id").cast("bigint") / 1000).alias("part")).agg(array.alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    back = S.read_history(spark, path).unionByName(S.read_history(spark, path + "-missing"))
    return back.select("run_id", "pipeline", "passed", F.col("recorded_at").cast("timestamp_ntz").alias("recorded_at"))


@query(
    "run_entries",
    f"""{EVENTS}, r AS (SELECT pipeline || '-' || strftime(triggered_at, '%Y%m%d') AS run_id, * FROM alert_event)
SELECT run_id, pipeline, bool_and(passed) AS passed, CASE WHEN bool_and(passed) THEN 'PASS' ELSE 'FAIL' END AS status, count(*) AS total_checks,
  count(*) FILTER (NOT passed) AS failed_checks, count(*) FILTER (NOT passed AND severity = 'critical') AS alert_count, max(triggered_at) AS recorded_at FROM r GROUP BY ALL""",
)
def run_entries(spark, folder):
    run = F.concat(F.col("pipeline"), F.lit("-"), F.date_format("triggered_at", "yyyyMMdd"))
    r = D.alert_events(spark, folder).withColumn("run_id", run)
    return S.run_entries(r, r.filter("not passed and severity = 'critical'"), F.col("triggered_at"))


@query(
    "read_jsonl",
    "SELECT event_id, event_type, value FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0",
)
def read_jsonl(spark, folder):
    """Event lines, some of them blank or cut off, written as text and read as JSON lines."""
    path = work_folder(spark, "lines")
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    text = F.when(F.col("event_id") % 17 == 0, "").when(F.col("event_id") % 19 == 0, F.substring(line, 1, 20)).otherwise(line)
    D.table(spark, folder, "events").select(text.alias("value")).write.text(path)
    return S.read_jsonl(spark, path, "event_id bigint, event_type string, value double")


@query(
    "parse_jsonl",
    "SELECT event_id, event_type, value FROM events WHERE event_id % 17 <> 0 AND event_id % 19 <> 0",
)
def parse_jsonl(spark, folder):
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    text = F.when(F.col("event_id") % 17 == 0, " ").when(F.col("event_id") % 19 == 0, F.substring(line, 1, 20)).otherwise(line)
    lines = D.table(spark, folder, "events").select(text.alias("value"))
    return S.parse_lines(lines, "event_id bigint, event_type string, value double")


@query("archive_sink", "SELECT event_id, event_type, value FROM events WHERE ts < TIMESTAMP '2024-01-10'")
def archive_sink(spark, folder):
    """Old events appended to gzip JSON lines and read back."""
    path = work_folder(spark, "archive")
    old = D.table(spark, folder, "events").filter("ts < timestamp_ntz'2024-01-10 00:00:00'")
    S.write_archive(old.select("event_id", "event_type", "value"), path)
    return S.read_jsonl(spark, path, "event_id bigint, event_type string, value double")


@query(
    "audit_log",
    f"""{EVENTS} SELECT event_id AS entry_id, pipeline, 'check:' || check_name AS action, triggered_at AS at FROM alert_event WHERE pipeline = 'p4'
ORDER BY triggered_at DESC, event_id DESC LIMIT 50""",
)
def audit_log(spark, folder):
    """Two recordings, then the last entries of one pipeline; a log that was never written is empty."""
    path = work_folder(spark, "audit")
    log = D.alert_events(spark, folder).select(
        F.col("event_id").alias("entry_id"),
        "pipeline",
        F.concat(F.lit("check:"), F.col("check_name")).alias("action"),
        F.col("triggered_at").alias("at"),
    )
    for part in R.split(log, F.col("entry_id") % 2 == 0):
        S.append(part, path)
    schema = "entry_id bigint, pipeline string, action string, at timestamp_ntz"
    return S.audit_entries(S.read_table(spark, path, schema), "p4").unionByName(
        S.audit_entries(S.read_table(spark, path + "-missing", schema), "p4"))


@query(
    "checkpoint_table",
    f"""{EVENTS} SELECT event_id, pipeline, check_name, status, value, triggered_at FROM alert_event ORDER BY triggered_at DESC, event_id DESC LIMIT 50""",
)
def checkpoint_table(spark, folder):
    """Check results recorded in two parts; the last entries of all, and none of a missing table."""
    path = work_folder(spark, "checkpoints")
    schema = "event_id bigint, pipeline string, check_name string, status string, value double, triggered_at timestamp_ntz"
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "check_name", "status", "value", "triggered_at")
    for part in R.split(e, F.col("event_id") % 2 == 0):
        S.append(part, path)
    order = ["triggered_at", "event_id"]
    return S.last_entries(spark, path, schema, order).unionByName(
        S.last_entries(spark, path + "-missing", schema, order))


@query(
    "baseline_table",
    f"""{with_tables('metric')} SELECT pipeline, metric, max_by(value, (recorded_at, value)) AS value, max(recorded_at) AS captured_at FROM metric GROUP BY ALL""",
)
def baseline_table(spark, folder):
    """Values to nested JSON and back, then two upserts, each written as a new version and read back."""
    path = work_folder(spark, "baselines")
    schema = "pipeline string, metric string, value double, captured_at timestamp_ntz"
    m = D.metrics(spark, folder).withColumnRenamed("recorded_at", "captured_at")
    parsed = S.parse_baselines(S.baseline_json(m))
    cut = F.expr("timestamp_ntz'1997-01-01 00:00:00'")
    parts = R.split(parsed, F.col("captured_at") < cut)
    for version, part in enumerate(parts, 1):
        S.write_version(S.upsert_baselines(S.read_version(spark, path, version - 1, schema), part), path, version)
    return S.read_version(spark, path, 2, schema)


@query(
    "snapshot_table",
    f"""{with_tables('metric')} SELECT pipeline, metric, count(*) AS snapshots, max(recorded_at) AS last_at FROM metric GROUP BY ALL""",
)
def snapshot_table(spark, folder):
    """Two appends to one table, read back."""
    path = work_folder(spark, "snapshots")
    m = D.metrics(spark, folder)
    cut = F.expr("timestamp_ntz'1998-01-01 00:00:00'")
    for part in R.split(m, F.col("recorded_at") < cut):
        S.append(part, path)
    back = S.read_table(spark, path, "pipeline string, metric string, value double, recorded_at timestamp_ntz")
    return back.groupBy("pipeline", "metric").agg(
        F.count(F.lit(1)).alias("snapshots"), F.max("recorded_at").alias("last_at")
    )


@query(
    "requeue_table",
    f"""{EVENTS} SELECT event_id, pipeline, check_name, message, triggered_at AS enqueued_at, event_id % 4 AS attempts,
  CASE WHEN event_id % 4 > 0 THEN triggered_at + to_hours(event_id % 4) END AS last_attempt_at FROM alert_event WHERE NOT passed AND event_id % 5 <> 0""",
)
def requeue_table(spark, folder):
    e = D.alert_events(spark, folder)
    queued = S.enqueue_failures(e, F.col("triggered_at"))
    tries = (
        e.filter("not passed and event_id % 4 > 0")
        .select("event_id", "triggered_at", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("event_id") % 4)).alias("i"))
        .select("event_id", F.expr("triggered_at + make_dt_interval(0, cast(i as int))").alias("attempted_at"))
    )
    done = e.filter("event_id % 5 = 0")
    return S.remove_from_queue(S.apply_attempts(queued, tries), done)


DELIVERY_SQL = """SELECT event_id, channel, channel = 'log' AS success, CASE WHEN channel <> 'log' THEN 'Unsupported alert channel: ''' || channel || '''' END AS error_message
FROM alert_event, (VALUES ('log'), ('chat'), ('mail')) c(channel)"""


@query("delivery_log", f"{EVENTS} {DELIVERY_SQL}")
def delivery_log(spark, folder):
    return S.deliveries(D.alert_events(spark, folder), ["log", "chat", "mail"]).select("event_id", "channel", "success", "error_message")


@query("failed_deliveries", f"{EVENTS} {DELIVERY_SQL} WHERE channel <> 'log'")
def failed_deliveries(spark, folder):
    return S.failed_deliveries(delivery_log(spark, folder))


@query(
    "webhook_payload",
    f"""{EVENTS} SELECT event_id, '{{"pipeline":"' || pipeline || '","check":"' || check_name || '","severity":"' || severity || '","message":"' || message
  || '","triggered_at":"' || strftime(triggered_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(triggered_at) % 1000000 = 0 THEN '' ELSE strftime(triggered_at, '.%f') END || '"}}' AS payload FROM alert_event""",
)
def webhook_payload(spark, folder):
    return S.webhook_payload(D.alert_events(spark, folder))


@query(
    "chat_payload",
    f"""{EVENTS} SELECT event_id, '{{"text":"' || CASE WHEN passed THEN ':white_check_mark:' ELSE ':red_circle:' END || ' *Alert* — rule `' || rule_name || '`\\nCheck: `' || check_name
  || '` | Severity: `' || severity || '`\\nStatus: `' || status || '` — ' || message || '"}}' AS payload FROM alert_event""",
)
def chat_payload(spark, folder):
    return S.chat_payload(D.alert_events(spark, folder))


@query(
    "partition_sink",
    f"{EVENTS} SELECT severity, count(*) AS n, sum(event_id)::BIGINT AS ids FROM alert_event GROUP BY 1",
)
def partition_sink(spark, folder):
    """Write one folder per severity and read it back."""
    path = work_folder(spark, "partitions")
    S.write_partitioned(D.alert_events(spark, folder).select("event_id", "pipeline", "severity"), path, "severity")
    return spark.read.parquet(path).groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


@query(
    "union_failures_and_newest",
    f"""{EVENTS}, p AS (SELECT event_id, passed FROM alert_event WHERE passed ORDER BY triggered_at DESC, event_id DESC LIMIT 500)
SELECT event_id, passed FROM alert_event WHERE NOT passed UNION ALL SELECT * FROM p""",
)
def union_failures_and_newest(spark, folder):
    e = D.alert_events(spark, folder)
    newest = e.filter("passed").orderBy(F.desc("triggered_at"), F.desc("event_id")).limit(500)
    return e.filter("not passed").select("event_id", "passed").unionByName(newest.select("event_id", "passed"))
