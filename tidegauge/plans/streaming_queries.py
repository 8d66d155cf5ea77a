"""Streams run over all available input, then the table they wrote is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder
from tidegauge.operators import checks as C
from tidegauge.operators import enrich as E
from tidegauge.operators import filters as R
from tidegauge.operators.machines import Backoff, Batch, Breaker, Cooldown, Quota
from tidegauge.plans.filter_queries import MAINTENANCE_SQL, SILENCED, maintenance, silence_rules
from tidegauge.plans.ordered_queries import BATCH_SQL, BY_PIPELINE, FLAGSHIP_RULES, WALK
from tidegauge.plans.registry import SQL, query, rule_table
from tidegauge.sources import stores as S
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import AS_OF, with_tables
from tidegauge.streaming import streams as X

HOUR = 3_600_000_000


def finish(spark, rows, name):
    """Run a stream to the end of its input and read back what it appended."""
    path = work_folder(spark, name)
    stream = X.to_table(rows, f"{path}/rows", f"{path}/progress")
    stream.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


CLOSED = """closed AS (SELECT *, start_at + INTERVAL {size} AS end_at FROM b)
SELECT start_at, end_at, count(*) AS count, count(*) FILTER (severity <> 'info') AS failure_count, count(DISTINCT pipeline) AS pipeline_count
FROM closed WHERE end_at <= (SELECT date_trunc('milliseconds', max(triggered_at)) FROM alert_event) - INTERVAL 10 MINUTE GROUP BY ALL"""


@query(
    "stream_tumbling",
    f"""{with_tables('alert_event')}, b AS (SELECT time_bucket(INTERVAL 1 HOUR, triggered_at) AS start_at, * FROM alert_event), {CLOSED.format(size='1 HOUR')}""",
)
def stream_tumbling(spark, folder):
    out = finish(spark, X.windowed_counts(D.alert_event_stream(spark, folder), "1 hour"), "tumbling")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


@query(
    "stream_sliding",
    f"""{with_tables('alert_event')}, b AS (SELECT time_bucket(INTERVAL 30 MINUTE, triggered_at) - to_minutes(30 * i) AS start_at, e.* FROM alert_event e, range(0, 4) r(i)),
{CLOSED.format(size='2 HOUR')}""",
)
def stream_sliding(spark, folder):
    out = finish(spark, X.windowed_counts(D.alert_event_stream(spark, folder), "2 hours", "30 minutes"), "sliding")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")})


def stateful(spark, folder, machine, keys, name):
    with X.rocksdb_state(spark):
        out = finish(spark, X.suppress(D.alert_event_stream(spark, folder), machine, keys), name)
    # The micro-batches come in order of time, so nothing may be late.
    return out.filter(F.coalesce(F.assert_true(~F.col("late")).cast("boolean"), F.lit(True))).drop("late")


@query("stream_dedupe", SQL["dedupe"])
def stream_dedupe(spark, folder):
    keys = ["pipeline", "check_name"]
    return stateful(spark, folder, Cooldown(12 * HOUR), keys, "dedupe").select("event_id", "fired")


@query("stream_cooldown", SQL["cooldown"])
def stream_cooldown(spark, folder):
    out = stateful(spark, folder, Cooldown(6 * HOUR), ["pipeline", "check_name"], "cooldown")
    last = F.timestamp_micros("last_fired_us").cast("timestamp_ntz")
    return out.select("event_id", (~F.col("fired")).alias("cooling"), (last + F.expr("interval 6 hours")).alias("expires_at"))


@query("stream_rate_limit", SQL["rate_limit"])
def stream_rate_limit(spark, folder):
    return stateful(spark, folder, Quota(5, 24 * HOUR), ["pipeline"], "rate")


@query(
    "stream_watermark",
    f"""{with_tables('alert_event')}, m AS (SELECT *, max(triggered_at) OVER w AS watermark FROM alert_event WINDOW w AS (PARTITION BY pipeline ORDER BY triggered_at, event_id)),
l AS (SELECT *, lag(watermark) OVER (PARTITION BY pipeline ORDER BY triggered_at, event_id) AS b FROM m)
SELECT event_id, epoch_us(watermark) AS watermark_us, coalesce(triggered_at <= b, false) AS behind FROM l""",
)
def stream_watermark(spark, folder):
    return stateful(spark, folder, X.Watermark(), ["pipeline"], "watermark")


@query("stream_quota", SQL["quota"])
def stream_quota(spark, folder):
    return stateful(spark, folder, Quota(3, 12 * HOUR), ["pipeline"], "quota")


@query("stream_circuit_breaker", SQL["circuit_breaker"])
def stream_circuit_breaker(spark, folder):
    return stateful(spark, folder, Breaker(2, 3 * HOUR), ["pipeline"], "breaker")


@query("stream_debounce", SQL["debounce"])
def stream_debounce(spark, folder):
    return stateful(spark, folder, X.Streak(2), ["pipeline", "check_name"], "debounce")


@query(
    "stream_throttle",
    f"SELECT event_id, suppressed_count, throttled FROM ({SQL['throttle']})",
)
def stream_throttle(spark, folder):
    return stateful(spark, folder, X.Throttle(10 * HOUR, 2), ["pipeline", "check_name"], "throttle")


@query("stream_backoff", SQL["backoff"])
def stream_backoff(spark, folder):
    return stateful(spark, folder, Backoff(7200, 2, 172800, 5), ["pipeline", "check_name"], "backoff")


@query("stream_batch", SQL["batch"])
def stream_batch(spark, folder):
    return stateful(spark, folder, Batch(5, 6 * HOUR), ["pipeline"], "batch")


def released(name):
    """What a query says of the events whose slot the watermark has passed at the end of the stream."""
    return f"""{with_tables('alert_event')}, e AS (SELECT event_id FROM alert_event WHERE triggered_at <
  time_bucket(INTERVAL 1 HOUR, (SELECT date_trunc('milliseconds', max(triggered_at)) FROM alert_event) - INTERVAL 24 HOUR))
SELECT q.* FROM ({SQL[name]}) q JOIN e USING (event_id)"""


def in_order(spark, folder, machine, keys, name):
    """Events that come up to eleven hours before or after their turn, put in order behind a watermark of a day."""
    events = D.alert_event_stream(spark, folder, disorder_seconds=11 * 3600)
    with X.rocksdb_state(spark):
        return finish(spark, X.suppress_in_order(events, machine, keys, "24 hours", 3600), name)


@query("stream_dedupe_in_order", released("dedupe"))
def stream_dedupe_in_order(spark, folder):
    keys = ["pipeline", "check_name"]
    return in_order(spark, folder, Cooldown(12 * HOUR), keys, "dedupe-in-order").select("event_id", "fired")


@query("stream_quota_in_order", released("quota"))
def stream_quota_in_order(spark, folder):
    return in_order(spark, folder, Quota(3, 12 * HOUR), ["pipeline"], "quota-in-order")


@query("stream_breaker_in_order", released("circuit_breaker"))
def stream_breaker_in_order(spark, folder):
    return in_order(spark, folder, Breaker(2, 3 * HOUR), ["pipeline"], "breaker-in-order")


@query(
    "stream_buffers",
    f"""{WALK}, {BY_PIPELINE}, {BATCH_SQL.format(n=8, w='9 HOUR')},
g AS (SELECT pipeline, batch_no::BIGINT AS batch_no, count(*) AS size, epoch_us(min(triggered_at)) AS opened_us, epoch_us(max(triggered_at)) AS last_us, bool_or(closes) AS closed FROM f GROUP BY ALL)
SELECT pipeline, batch_no, size, opened_us, last_us, CASE WHEN size >= 8 THEN 'size' ELSE 'age' END AS reason FROM g
WHERE closed OR opened_us + 9 * 3600000000 <= (SELECT epoch_us(max(triggered_at)) - 600000000 FROM alert_event)""",
)
def stream_buffers(spark, folder):
    with X.rocksdb_state(spark):
        return finish(spark, X.buffers(D.alert_event_stream(spark, folder), 8, 9 * 3600), "buffers")


@query(
    "stream_latest",
    f"""{with_tables('alert_event')} SELECT pipeline, check_name, max_by(event_id, (triggered_at, event_id)) AS event_id,
  max_by(status, (triggered_at, event_id)) AS status FROM alert_event GROUP BY ALL""",
)
def stream_latest(spark, folder):
    with X.rocksdb_state(spark):
        out = finish(spark, X.latest_results(D.alert_event_stream(spark, folder)), "latest")
    # A key is emitted in every micro-batch that changes it.
    return out.groupBy("pipeline", "check_name").agg(
        F.max_by(F.struct("event_id", "status"), F.struct("at_us", "event_id")).alias("r")
    ).select("pipeline", "check_name", "r.*")


@query(
    "stream_drop_repeats",
    f"""{with_tables('alert_event')} SELECT DISTINCT pipeline, check_name, 1::BIGINT AS kept FROM alert_event""",
)
def stream_drop_repeats(spark, folder):
    """How many events of each key passed the simple de-duplication of the stream: one."""
    rows = X.drop_repeats(D.alert_event_stream(spark, folder), ["pipeline", "check_name"], "30 days")
    out = finish(spark, rows.select("pipeline", "check_name"), "repeats")
    return out.groupBy("pipeline", "check_name").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "stream_rules",
    f"""{with_tables('alert_event')}, rule(rule_name, c, op, threshold, severity) AS (VALUES ('slow error', 'error', 'gt', 100.0, 'critical'),
  ('large purchase', 'purchase', 'gte', 250.0, 'warning'), ('tiny view', 'view', 'lt', 2.0, 'info')),
fired AS (SELECT e.event_id, e.pipeline, e.check_name, rule.rule_name, rule.severity, e.triggered_at FROM alert_event e JOIN rule ON check_name = c
  AND CASE op WHEN 'gt' THEN value > rule.threshold WHEN 'gte' THEN value >= rule.threshold ELSE value < rule.threshold END),
{MAINTENANCE_SQL}
SELECT event_id, rule_name, severity, channel, channel = 'log' AS success FROM fired e, (VALUES ('log'), ('chat')) ch(channel)
WHERE NOT {SILENCED} AND NOT EXISTS (SELECT 1 FROM w WHERE p = e.pipeline AND e.triggered_at BETWEEN start_at AND end_at)""",
)
def stream_rules(spark, folder):
    """Metric rules, silences and maintenance windows on every micro-batch, fanned out to channels."""
    rules = rule_table(
        spark, "name string, metric string, operator string, threshold double, severity string", FLAGSHIP_RULES
    ).withColumn("pipeline", F.lit(None).cast("string"))
    quiet, windows = silence_rules(spark), maintenance(spark)

    def records(batch):
        at = F.struct(F.col("triggered_at").cast("timestamp_ntz").alias("t"), "event_id")
        readings = batch.select("pipeline", F.col("check_name").alias("metric"), "value", at.alias("recorded_at"))
        fired = C.metric_alerts(readings, rules).select(
            F.col("recorded_at.event_id").alias("event_id"), "pipeline", F.col("metric").alias("check_name"),
            "rule_name", "severity", F.col("recorded_at.t").alias("triggered_at"),
        )
        left = R.in_maintenance(R.silence(fired, quiet, AS_OF), windows)
        return S.deliveries(left, ["log", "chat"]).select("event_id", "rule_name", "severity", "channel", "success")

    path = work_folder(spark, "rules")
    events = D.alert_event_stream(spark, folder).transform(E.mask_metadata)
    X.deliver(events, records, f"{path}/records", f"{path}/progress").awaitTermination()
    return spark.read.parquet(f"{path}/records").drop("batch")
