"""Canonical tables derived from the TPC-H-like parquet tables.

Each function takes ``(spark, folder)`` and returns a lazy DataFrame. Columns
are projected late, so a query reads only the columns it uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.common import use_utc, work_folder

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def alert_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_alert_events(table(spark, folder, "events"))


#: Files of a micro-batch in the event stream.
FILES = 2


def alert_event_stream(spark: SparkSession, folder: str, slices: int = 5, disorder_seconds: int = 0) -> DataFrame:
    """The same rows as a stream of several micro-batches; times become TIMESTAMP, which watermarks need.

    The events are cut into slices of time, which are written one after the other, each as
    the files of one micro-batch. Rows without a time are in the first slice. With
    ``disorder_seconds`` events come up to so much before or after their turn.
    """
    events = table(spark, folder, "events")
    path = work_folder(spark, "event-stream")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:  # no times: one slice, which may be empty
        events.repartition(FILES).write.mode("append").parquet(path)
    else:
        step = (high - low) / slices
        away = F.pmod(F.xxhash64("event_id"), F.lit(2 * disorder_seconds + 1)) - disorder_seconds
        turn = F.col("ts") + F.make_dt_interval(secs=away.cast("decimal(18,6)")) if disorder_seconds else F.col("ts")
        for i in range(slices):
            own = F.lit(True) if i == 0 else turn >= F.lit(low + i * step)
            if i + 1 < slices:
                own = own & (turn < F.lit(low + (i + 1) * step))
            if i == 0:
                own = own | F.col("ts").isNull()
            events.filter(own).repartition(FILES).write.mode("append").parquet(path)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    return as_alert_events(raw).withColumn("triggered_at", F.col("triggered_at").cast("timestamp"))


def as_alert_events(e: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    pipeline = F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string"))
    passed = F.col("value") >= 5
    severity = (
        F.when(F.col("event_type") == "error", "critical")
        .when(F.col("event_type") == "purchase", "warning")
        .otherwise("info")
    )
    return e.select(
        "event_id",
        pipeline.alias("pipeline"),
        F.col("event_type").alias("check_name"),
        F.concat("event_type", F.lit("_rule")).alias("rule_name"),
        severity.alias("severity"),
        F.when(passed, "pass").otherwise("fail").alias("status"),
        passed.alias("passed"),
        "value",
        F.lit(5.0).alias("threshold"),
        F.concat(F.lit("value of "), F.col("event_type")).alias("message"),
        F.array(F.col("event_type"), F.concat(F.lit("k"), (k % 5).cast("string"))).alias("tags"),
        F.create_map(
            F.lit("k"), k.cast("string"),
            F.lit("user_id"), F.col("user_id").cast("string"),
            F.lit("api_key"), F.concat(F.lit("key-"), F.col("user_id").cast("string")),
            F.lit("token"), F.concat(F.lit("tok-"), F.col("event_id").cast("string")),
        ).alias("metadata"),
        F.col("ts").alias("triggered_at"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    passed = F.col("o_orderstatus") != "F"
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("pipeline"),
        F.lit("order_status").alias("check_name"),
        F.lit("total_price").alias("metric"),
        F.col("o_totalprice").alias("value"),
        passed.alias("passed"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        F.lit(1).cast("bigint").alias("total_checks"),
        F.when(passed, 0).otherwise(1).cast("bigint").alias("failed_checks"),
        F.when(passed, 0).otherwise(1).cast("bigint").alias("alert_count"),
        F.col("o_orderdate").alias("recorded_at"),
    )


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Daily mean quantity, rounded so that the order of the float sum does not show."""
    li = table(spark, folder, "lineitem")
    return (
        li.groupBy("l_returnflag", "l_linestatus", "l_shipdate")
        .agg(F.round(F.avg("l_quantity"), 4).alias("value"))
        .select(
            F.col("l_returnflag").alias("pipeline"),
            F.col("l_linestatus").alias("metric"),
            "value",
            F.col("l_shipdate").alias("recorded_at"),
        )
    )


def profile_samples(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample_id"),
        F.col("l_returnflag").alias("pipeline"),
        F.col("l_linestatus").alias("check_name"),
        F.col("l_extendedprice").alias("duration_ms"),
        F.col("l_shipdate").alias("recorded_at"),
    )


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """One trace per conversation; the last turn of every seventh trace stays open."""
    c = table(spark, folder, "conversations")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    started = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn)")
    ended = F.expr(
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn + length(text) / 1000.0)"
    )
    is_open = (F.col("turn") == F.col("last_turn")) & (F.col("conv_id") % 7 == 0)
    return c.join(last, "conv_id").select(
        F.col("conv_id").cast("string").alias("trace_id"),
        F.col("turn").cast("string").alias("span_id"),
        F.when(F.col("turn") > 0, F.lit("0")).alias("parent_span_id"),
        F.lit("chat").alias("pipeline"),
        F.col("role").alias("check_name"),
        F.when(F.length("text") % 5 == 0, "error").otherwise("ok").alias("status"),
        started.alias("started_at"),
        F.when(~is_open, ended).alias("ended_at"),
    )


def edges(spark: SparkSession, folder: str, acyclic: bool = False) -> DataFrame:
    """Nation-to-nation trade edges (supplier nation to customer nation)."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    e = (
        li.join(s, li.l_suppkey == s.s_suppkey)
        .join(o, li.l_orderkey == o.o_orderkey)
        .join(c, o.o_custkey == c.c_custkey)
        .select(
            F.format_string("n%02d", F.col("s_nationkey")).alias("upstream"),
            F.format_string("n%02d", F.col("c_nationkey")).alias("downstream"),
        )
        .distinct()
    )
    return e.filter("upstream < downstream") if acyclic else e


# The same derivations as common table expressions for the SQL oracle.
ORACLE_CTES = {
    "alert_event": """alert_event AS (
  SELECT event_id, 'p' || (user_id % 25) AS pipeline, event_type AS check_name,
    event_type || '_rule' AS rule_name,
    CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity,
    CASE WHEN value >= 5 THEN 'pass' ELSE 'fail' END AS status, value >= 5 AS passed, value,
    5.0::DOUBLE AS threshold, 'value of ' || event_type AS message,
    [event_type, 'k' || (CAST(regexp_extract(props, '(\\d+)', 1) AS INT) % 5)] AS tags,
    CAST(regexp_extract(props, '(\\d+)', 1) AS INT) AS k, user_id, ts AS triggered_at
  FROM events)""",
    "history": """history AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS pipeline, 'order_status' AS check_name,
    'total_price' AS metric, o_totalprice AS value, o_orderstatus <> 'F' AS passed,
    CASE WHEN o_orderstatus <> 'F' THEN 'PASS' ELSE 'FAIL' END AS status,
    CASE WHEN o_orderstatus <> 'F' THEN 0 ELSE 1 END AS failed_checks,
    o_orderdate AS recorded_at FROM orders)""",
    "metric": """metric AS (
  SELECT l_returnflag AS pipeline, l_linestatus AS metric, round(avg(l_quantity), 4) AS value,
    l_shipdate AS recorded_at FROM lineitem GROUP BY ALL)""",
    "profile_sample": """profile_sample AS (
  SELECT l_orderkey * 10 + l_linenumber AS sample_id, l_returnflag AS pipeline,
    l_linestatus AS check_name, l_extendedprice AS duration_ms, l_shipdate AS recorded_at
  FROM lineitem)""",
    "span": """span AS (
  SELECT CAST(conv_id AS VARCHAR) AS trace_id, CAST(turn AS VARCHAR) AS span_id,
    CASE WHEN turn > 0 THEN '0' END AS parent_span_id, role AS check_name,
    CASE WHEN length(text) % 5 = 0 THEN 'error' ELSE 'ok' END AS status,
    TIMESTAMP '2024-01-01' + to_microseconds(turn * 1000000) AS started_at,
    CASE WHEN NOT (turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 7 = 0)
      THEN TIMESTAMP '2024-01-01' + to_microseconds(turn * 1000000 + length(text) * 1000) END AS ended_at
  FROM conversations)""",
    "edge": """edge AS (
  SELECT DISTINCT printf('n%02d', s_nationkey) AS upstream, printf('n%02d', c_nationkey) AS downstream
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey)""",
}


def with_tables(*names: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(ORACLE_CTES[n] for n in names)
