"""Transforms, normalization, masking, enrichment, labels, scores and retry plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions import metrics as M
from tidegauge.functions.common import broadcast_if_small
from tidegauge.operators import enrich as E
from tidegauge.operators.ordered import recurrence
from tidegauge.plans.registry import query, rule_table
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import with_tables

EVENTS = with_tables("alert_event")


@query(
    "transform_functions",
    """SELECT c_custkey, abs(v) AS abs, -v AS negate, round_even(v, 0) AS round, trunc(v) AS floor, trunc(v) AS ceil,
  round(CASE WHEN v > 0 THEN log10(v) ELSE 0 END, 9)::DOUBLE AS log10, round(CASE WHEN v >= 0 THEN sqrt(v) ELSE 0 END, 9)::DOUBLE AS sqrt,
  floor(v) AS true_floor, ceil(v) AS true_ceil
FROM (SELECT c_custkey, c_acctbal * 0.5 + 1 AS v FROM customer)""",
)
def transform_functions(spark, folder):
    c = D.table(spark, folder, "customer")
    cols = []
    for name in M.TRANSFORMS:
        x = M.transformed("c_acctbal", name, 0.5, 1.0)
        cols.append((F.round(x, 9) if name in ("log10", "sqrt") else x).alias(name))
    return c.select("c_custkey", *cols)


@query(
    "transform",
    """SELECT event_id, value AS original, abs(value * -2.0 + 10.0)::DOUBLE AS transformed, value <> abs(value * -2.0 + 10.0) AS changed,
  'scale(-2.0),offset(10.0),fn(abs)' AS steps FROM events""",
)
def transform(spark, folder):
    out = E.transform_values(D.table(spark, folder, "events"), "abs", -2.0, 10.0)
    return out.select(
        "event_id", F.col("value").alias("original"), "transformed", "changed", F.array_join("steps", ",").alias("steps")
    )


@query(
    "transform_by_rule",
    f"""{with_tables('metric')} SELECT pipeline, metric, recorded_at, CASE metric WHEN 'F' THEN trunc(value * 3.0 + 0.5) ELSE -(value * 1.0 - 25.0) END::DOUBLE AS transformed
FROM metric WHERE metric IN ('F', 'O')""",
)
def transform_by_rule(spark, folder):
    rules = rule_table(
        spark,
        "metric string, fn string, scale double, offset double",
        [("F", "ceil", 3.0, 0.5), ("O", "negate", 1.0, -25.0), ("X", "abs", 1.0, 0.0)],
    )
    return E.transform_by_rule(D.metrics(spark, folder), rules).select("pipeline", "metric", "recorded_at", "transformed")


@query(
    "normalize",
    """WITH m AS (SELECT event_id, event_type AS metric, value FROM events),
h AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std FROM m GROUP BY 1)
SELECT event_id, metric, CASE metric WHEN 'click' THEN 'minmax' WHEN 'error' THEN 'zscore' ELSE 'clamp' END AS strategy,
  round(CASE metric WHEN 'click' THEN (value - 10.0) / 190.0 WHEN 'error' THEN (value - mean) / std
    ELSE least(greatest(value, 20.0), CASE metric WHEN 'purchase' THEN 60.0 ELSE value END) END, 6)::DOUBLE AS normalized
FROM m JOIN h USING (metric) WHERE metric IN ('click', 'error', 'purchase')""",
)
def normalize(spark, folder):
    rules = rule_table(
        spark,
        "rule_idx int, metric string, strategy string, min_val double, max_val double, clamp_low double, clamp_high double",
        [
            (1, "click", "clamp", 0.0, 1.0, 0.0, 1.0),
            (2, "error", "zscore", 0.0, 1.0, None, None),
            (3, "purchase", "clamp", 0.0, 1.0, 20.0, 60.0),
            (4, "click", "minmax", 10.0, 200.0, None, None),
        ],
    )
    m = D.table(spark, folder, "events").select("event_id", F.col("event_type").alias("metric"), "value")
    out = E.normalize(m, rules, m)
    return out.select("event_id", "metric", "strategy", F.round("normalized", 6).alias("normalized"))


def map_text(name="metadata"):
    pairs = F.transform(F.array_sort(F.map_entries(name)), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return F.array_join(pairs, ";")


@query(
    "mask_metadata",
    f"""{EVENTS} SELECT event_id, 'api_key=***;k=' || k || ';token=***;user_id=' || user_id AS metadata, 'api_key,token' AS masked_keys FROM alert_event""",
)
def mask_metadata(spark, folder):
    out = E.mask_metadata(D.alert_events(spark, folder))
    return out.select("event_id", map_text().alias("metadata"), F.array_join("masked_keys", ",").alias("masked_keys"))


@query(
    "redact_metadata",
    f"""{EVENTS} SELECT event_id, 'api_key=***REDACTED***;k=' || k || ';token=***REDACTED***;user_id=' || user_id AS metadata FROM alert_event""",
)
def redact_metadata(spark, folder):
    return E.redact_metadata(D.alert_events(spark, folder)).select("event_id", map_text().alias("metadata"))


@query("mask_columns", "SELECT doc_id, '***' AS text_token, lang FROM documents")
def mask_columns(spark, folder):
    d = D.table(spark, folder, "documents").select("doc_id", F.col("text").alias("text_token"), "lang")
    return E.mask_columns(d)


@query(
    "enrich",
    f"""{EVENTS} SELECT event_id, 'api_key=key-' || user_id || ';env=prod;host=h2;k=' || n_name || ';severity=' || severity || ';token=tok-' || event_id || ';user_id=' || user_id AS metadata
FROM alert_event JOIN nation ON n_nationkey = user_id % 25""",
)
def enrich(spark, folder):
    nations = D.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("_n"), "n_name")

    def from_nation(d):
        n = (F.col("metadata").getItem("user_id").cast("bigint") % 25) == F.col("_n")
        return E.add_metadata(d.join(broadcast_if_small(nations), n), k=F.col("n_name")).drop("_n", "n_name")

    steps = [*E.default_enrichers("dev", "h1"), *E.default_enrichers("prod", "h2"), from_nation]
    return E.enrich(D.alert_events(spark, folder), steps).select("event_id", map_text().alias("metadata"))


@query(
    "label",
    f"""{EVENTS} SELECT event_id, concat_ws(';', CASE WHEN severity = 'critical' THEN 'page=yes' END,
  'team=' || CASE WHEN pipeline = 'p3' AND severity = 'warning' THEN 'three-w' WHEN pipeline = 'p3' THEN 'three' ELSE 'all' END) AS labels FROM alert_event""",
)
def label(spark, folder):
    rules = rule_table(
        spark,
        "rule_idx int, pipeline string, severity string, key string, value string",
        [
            (1, None, None, "team", "all"),
            (2, "p3", None, "team", "three"),
            (3, None, "critical", "page", "yes"),
            (4, "p3", "warning", "team", "three-w"),
        ],
    )
    return E.label(D.alert_events(spark, folder), rules).select("event_id", map_text("labels").alias("labels"))


@query(
    "fingerprint",
    f"""{EVENTS} SELECT event_id, sha256('{{"check": "' || check_name || '", "pipeline": "' || pipeline || '", "severity": "' || severity || '"}}') AS digest FROM alert_event""",
)
def fingerprint(spark, folder):
    return D.alert_events(spark, folder).select("event_id", E.fingerprint().alias("digest"))


@query(
    "priority_score",
    f"""{EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY pipeline, check_name ORDER BY triggered_at, event_id) AS recurrence FROM alert_event),
s AS (SELECT event_id, recurrence, CASE severity WHEN 'critical' THEN 100 WHEN 'warning' THEN 50 ELSE 10 END AS base_score,
  least(5 * greatest(recurrence - 1, 0), 50) AS recurrence_bonus, CASE WHEN list_has_any(tags, ['k2', 'error']) THEN 20 ELSE 0 END AS tag_bonus FROM r)
SELECT *, base_score + recurrence_bonus + tag_bonus AS priority FROM s""",
)
def priority_score(spark, folder):
    e = D.alert_events(spark, folder).select("event_id", "pipeline", "check_name", "severity", "tags", "triggered_at")
    out = E.with_priority(recurrence(e), ["k2", "error"])
    return out.select("event_id", "recurrence", "base_score", "recurrence_bonus", "tag_bonus", "priority")


@query(
    "changes",
    """WITH t AS (SELECT o_orderkey, o_totalprice AS a, c_acctbal AS b FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, round(a - b, 6) AS delta, round((a - b) / abs(nullif(b, 0)) * 100, 6) AS pct, round((a - b) / nullif(b, 0) * 100, 1) AS signed_pct FROM t""",
)
def changes(spark, folder):
    o, c = D.table(spark, folder, "orders"), D.table(spark, folder, "customer")
    t = o.join(c, o.o_custkey == c.c_custkey)
    a, b = "o_totalprice", "c_acctbal"
    return t.select(
        "o_orderkey",
        F.round(M.delta(a, b), 6).alias("delta"),
        F.round(M.pct_change(a, b), 6).alias("pct"),
        F.round(F.try_divide(M.delta(a, b), F.col(b)) * 100, 1).alias("signed_pct"),
    )


PLAN_SQL = f"""{EVENTS}, plan AS (SELECT event_id, attempt, least(60.0 * pow(2.0, attempt - 1), 3600.0)::DOUBLE AS delay_seconds, triggered_at
  FROM alert_event, range(1, 6) r(attempt) WHERE NOT passed),
total AS (SELECT *, sum(delay_seconds) OVER (PARTITION BY event_id ORDER BY attempt) AS total_delay_seconds FROM plan)"""


@query(
    "retry_plan",
    f"{PLAN_SQL} SELECT event_id, attempt::INT AS attempt, delay_seconds, total_delay_seconds, triggered_at + to_seconds(total_delay_seconds::BIGINT) AS retry_at FROM total",
)
def retry_plan(spark, folder):
    failed = D.alert_events(spark, folder).filter("not passed")
    return E.retry_plan(failed).select("event_id", "attempt", "delay_seconds", "total_delay_seconds", "retry_at")


@query(
    "jitter",
    f"""{PLAN_SQL}, u AS (SELECT *, ('0x' || substr(md5(event_id || '|' || attempt || '|7'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
  greatest(10.0, least(delay_seconds, 600.0))::DOUBLE AS top FROM plan)
SELECT event_id, attempt::INT AS attempt, round(10.0 + u * (top - 10.0), 6)::DOUBLE AS full_jitter,
  round(greatest(10.0, top / 2 + u * (top / 2)), 6)::DOUBLE AS equal_jitter,
  round(10.0 + u * (greatest(10.0, least(3 * delay_seconds, 600.0)) - 10.0), 6)::DOUBLE AS decorrelated_jitter FROM u""",
)
def jitter(spark, folder):
    plan = E.retry_plan(D.alert_events(spark, folder).filter("not passed"))
    for kind in ("full", "equal", "decorrelated"):
        plan = E.with_jitter(plan, kind, 10.0, 600.0, seed=7).withColumn(
            f"{kind}_jitter", F.round("jittered_seconds", 6)
        )
    return plan.select("event_id", "attempt", "full_jitter", "equal_jitter", "decorrelated_jitter")
