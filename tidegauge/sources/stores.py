"""Rule, history, audit, checkpoint, baseline, snapshot, requeue and delivery tables.

A store is a folder of parquet or JSON files. Writes append files; a table
whose rows are replaced is written as a new version next to the old one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions.common import col, json_text, require
from tidegauge.operators.checks import check_rules
from tidegauge.operators.limits import recent


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A parquet store, or no rows when it has not been written yet; files that can't be read have no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Alert rules from a JSON array: defaults applied, operators and severities checked."""
    raw = spark.read.schema(schemas.RULE).json(path, multiLine=True)
    return check_rules(raw)


def read_history(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Run history from a JSON array file (or files); newest first when limited; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.HISTORY)
    rows = spark.read.schema(schemas.HISTORY).json(path, multiLine=True)
    return rows if limit is None else recent(rows, ["recorded_at", "run_id"], limit)


def run_entries(results: DataFrame, alerts: DataFrame, recorded_at: Column) -> DataFrame:
    """One history row per run from its check results and alerts."""
    per = results.groupBy("run_id").agg(
        F.min("pipeline").alias("pipeline") if "pipeline" in results.columns else F.lit(None).cast("string").alias("pipeline"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") != "pass").alias("failed_checks"),
        F.max(recorded_at).alias("recorded_at"),
    )
    fired = alerts.groupBy("run_id").agg(F.count(F.lit(1)).alias("_alerts"))
    passed = F.col("failed_checks") == 0
    return per.join(fired, "run_id", "left").select(
        "run_id",
        "pipeline",
        passed.alias("passed"),
        F.when(passed, "PASS").otherwise("FAIL").alias("status"),
        "total_checks",
        "failed_checks",
        F.coalesce("_alerts", F.lit(0)).alias("alert_count"),
        "recorded_at",
    )


def append_history(entries: DataFrame, path: str) -> None:
    """Append runs, one folder per month, so that time filters prune files and files are not tiny."""
    append(entries.withColumn("month", F.trunc("recorded_at", "month")), path, ["month"])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same rule for lines that are already in a column."""
    text = F.trim(F.col(column))
    parsed = lines.filter(text != "").select(
        F.from_json(text, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("_r")
    )
    return parsed.filter(F.col("_r._bad").isNull()).select("_r.*").drop("_bad")


def write_archive(rows: DataFrame, path: str) -> None:
    """Append rows to gzip JSON lines."""
    rows.write.mode("append").option("compression", "gzip").json(path)


def write_partitioned(rows: DataFrame, path: str, key: str) -> None:
    """One folder per key value. Rows are spread over tasks as they are, so a frequent key has many files."""
    rows.write.mode("append").partitionBy(key).parquet(path)


def last_entries(spark: SparkSession, path: str, schema: str, order: Sequence[str], limit: int = 50) -> DataFrame:
    """The last ``limit`` entries of an appended store; no rows when nothing was recorded yet."""
    return recent(read_table(spark, path, schema), order, limit)


def audit_entries(log: DataFrame, pipeline: str | None = None, limit: int = 50) -> DataFrame:
    """The last ``limit`` audit entries, optionally of one pipeline."""
    return recent(log, ["at", "entry_id"], limit, pipeline)


def parse_baselines(text: DataFrame, column: str = "value") -> DataFrame:
    """Baseline rows from nested JSON ``{pipeline: {metric: {value, captured_at}}}``."""
    shape = "map<string, map<string, struct<value: double, captured_at: string>>>"
    outer = text.select(F.explode(F.from_json(column, shape)).alias("pipeline", "_m"))
    return outer.select("pipeline", F.explode("_m").alias("metric", "_e")).select(
        "pipeline",
        "metric",
        "_e.value",
        F.try_to_timestamp("_e.captured_at").cast("timestamp_ntz").alias("captured_at"),
    )


def baseline_json(baselines: DataFrame) -> DataFrame:
    """Baselines as nested JSON, one line per pipeline and metric."""
    entry = F.struct("value", F.col("captured_at").cast("string").alias("captured_at"))
    return baselines.select(F.to_json(F.create_map("pipeline", F.create_map("metric", entry))).alias("value"))


def upsert_baselines(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest value per (pipeline, metric)."""
    both = old.unionByName(new)
    return both.groupBy("pipeline", "metric").agg(
        F.max_by("value", F.struct("captured_at", "value")).alias("value"), F.max("captured_at").alias("captured_at")
    )


def write_version(df: DataFrame, path: str, version: int) -> None:
    """Write a whole new version of a store beside the ones before it."""
    require(version >= 0, "version must be >= 0")
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int, schema: str) -> DataFrame:
    """One version of a store; a version that was never written has no rows."""
    return read_table(spark, f"{path}/version={version}", schema)


def enqueue_failures(results: DataFrame, at: Column) -> DataFrame:
    """Queue rows for the failed checks."""
    return results.filter(F.col("status") != "pass").select(
        "event_id", "pipeline", "check_name", "message",
        at.alias("enqueued_at"), F.lit(0).cast("bigint").alias("attempts"),
    )


def apply_attempts(queue: DataFrame, attempts: DataFrame) -> DataFrame:
    """Add the attempts made to each queued row: how many, and the last time."""
    made = attempts.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("attempted_at").alias("last_attempt_at")
    )
    return (
        queue.join(made, "event_id", "left")
        .withColumn("attempts", F.col("attempts") + F.coalesce("_n", F.lit(0)))
        .drop("_n")
    )


def remove_from_queue(queue: DataFrame, done: DataFrame) -> DataFrame:
    return queue.join(done.select("event_id").distinct(), "event_id", "left_anti")


def deliveries(events: DataFrame, channels: Sequence[str] = ("log",)) -> DataFrame:
    """One record per event and channel; only ``log`` is supported, another one is a failed record."""
    names = list(channels) or ["log"]
    out = events.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in names])))
    ok = F.col("channel") == "log"
    # Fixed value: the wording of the error.
    text = F.concat(F.lit("Unsupported alert channel: '"), F.col("channel"), F.lit("'"))
    return out.withColumn("success", ok).withColumn("error_message", F.when(~ok, text))


def failed_deliveries(records: DataFrame) -> DataFrame:
    return records.filter(~F.col("success"))


def iso_text(ts: str | Column) -> Column:
    """ISO-8601 text; microseconds only when there are any."""
    t = col(ts)
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(t, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def webhook_payload(events: DataFrame) -> DataFrame:
    """Event id and JSON body (pipeline, check, severity, message, triggered_at)."""
    body = F.to_json(
        F.struct(
            "pipeline",
            F.col("check_name").alias("check"),
            "severity",
            "message",
            iso_text("triggered_at").alias("triggered_at"),
        )
    )
    return events.select("event_id", body.alias("payload"))


def chat_payload(events: DataFrame, title: str = "Alert") -> DataFrame:
    """Event id and chat message body."""
    # The layout of the message.
    icon = F.when(F.col("passed"), ":white_check_mark:").otherwise(":red_circle:")
    text = F.concat(
        icon, F.lit(f" *{title}* — rule `"), F.col("rule_name"),
        F.lit("`\nCheck: `"), F.col("check_name"),
        F.lit("` | Severity: `"), F.col("severity"),
        F.lit("`\nStatus: `"), F.col("status"), F.lit("` — "), F.col("message"),
    )
    return events.select("event_id", F.concat(F.lit('{"text":'), json_text(text), F.lit("}")).alias("payload"))
