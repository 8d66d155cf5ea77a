"""Data-quality checks, rules, reports and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.operators import checks as C
from tidegauge.operators import ordered as O
from tidegauge.plans.registry import query, rule_table
from tidegauge.sources import testdata as D
from tidegauge.sources.testdata import AS_OF, with_tables


@query(
    "check_row_count",
    """SELECT o_orderstatus, 'row_count' AS check_name,
  CASE WHEN n < 1000 OR n > 5000 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN n < 1000 THEN 'Row count ' || n || ' is below minimum 1000'
       WHEN n > 5000 THEN 'Row count ' || n || ' exceeds maximum 5000'
       ELSE 'Row count ' || n || ' is within expected range' END AS message,
  n::DOUBLE AS value, CASE WHEN n < 1000 THEN 1000.0::DOUBLE WHEN n > 5000 THEN 5000.0::DOUBLE END AS threshold
FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)""",
)
def check_row_count(spark, folder):
    return C.row_count_checks(D.table(spark, folder, "orders"), ["o_orderstatus"], 1000, 5000)


@query(
    "check_null_rate",
    """WITH t AS (SELECT o_orderpriority, count(*) AS n,
    count(*) - count(nullif(o_orderstatus, 'P')) AS a, count(*) - count(o_totalprice) AS b
  FROM orders GROUP BY 1),
u AS (SELECT o_orderpriority, 'status' AS "column", a / n AS value FROM t
  UNION ALL SELECT o_orderpriority, 'price', b / n FROM t)
SELECT o_orderpriority, 'null_rate' AS check_name, "column",
  CASE WHEN value > 0.05 THEN 'fail' ELSE 'pass' END AS status,
  printf('Null rate %.2f%%', value * 100) || ' for ''' || "column" || ''''
    || CASE WHEN value > 0.05 THEN ' exceeds max 5.00%' ELSE ' is acceptable' END AS message,
  value, 0.05::DOUBLE AS threshold FROM u""",
)
def check_null_rate(spark, folder):
    o = D.table(spark, folder, "orders").select(
        "o_orderpriority",
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.col("o_totalprice").alias("price"),
    )
    return C.null_rate_checks(o, ["status", "price"], 0.05, ["o_orderpriority"])


@query(
    "check_freshness",
    """WITH t AS (SELECT event_type, epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts)) AS us FROM events GROUP BY 1),
u AS (SELECT event_type, us / 1000000.0::DOUBLE AS value FROM t)
SELECT event_type, 'freshness' AS check_name, CASE WHEN value > 1200 THEN 'fail' ELSE 'pass' END AS status,
  CASE WHEN value > 1200 THEN printf('Data is %.0fs old, exceeds max 1200s', value)
       ELSE printf('Data freshness OK (%.0fs old)', value) END AS message,
  value, 1200.0::DOUBLE AS threshold FROM u""",
)
def check_freshness(spark, folder):
    e = D.table(spark, folder, "events")
    return C.freshness_checks(e, "ts", AS_OF, 1200, ["event_type"])


@query(
    "validate_customers",
    """SELECT c_custkey, 'c_acctbal' AS field, 'min' AS rule,
  'Field ''c_acctbal'' must be >= 0.0, got ' || c_acctbal || '.' AS message FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'regex', 'unexpected segment' FROM customer
  WHERE NOT regexp_full_match(c_mktsegment, 'BUILDING|MACHINERY|HOUSE.*')
UNION ALL SELECT c_custkey, 'c_name', 'type', 'Field ''c_name'' must be int, got string.' FROM customer WHERE c_name IS NOT NULL""",
)
def validate_customers(spark, folder):
    rules = [
        C.ValidationRule("c_acctbal", "min", 0.0),
        C.ValidationRule("c_mktsegment", "regex", "BUILDING|MACHINERY|HOUSE.*", "unexpected segment"),
        C.ValidationRule("c_name", "type", "int"),
        C.ValidationRule("c_nationkey", "type", "int"),
    ]
    c = D.table(spark, folder, "customer")
    return C.violation_rows(C.validate_records(c, rules), ["c_custkey"])


@query(
    "validate_documents",
    """SELECT doc_id,
  (CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END + CASE WHEN n_chars < 200 THEN 1 ELSE 0 END
   + CASE WHEN n_chars > 20000 THEN 1 ELSE 0 END + CASE WHEN NOT regexp_full_match(lang, 'en|fr') THEN 1 ELSE 0 END
  )::BIGINT AS violations,
  NOT (text IS NULL OR text = '' OR n_chars < 200 OR n_chars > 20000 OR NOT regexp_full_match(lang, 'en|fr')) AS passed
FROM documents""",
)
def validate_documents(spark, folder):
    rules = rule_table(
        spark,
        "rule_idx int, field string, rule string, value string, message string",
        [
            (1, "text", "required", None, None),
            (2, "n_chars", "min", "200", None),
            (3, "n_chars", "max", "20000", None),
            (4, "lang", "regex", "en|fr", None),
        ],
    )
    d = D.table(spark, folder, "documents")
    out = C.validate_records(d, C.validation_rules(rules))
    return out.select("doc_id", F.size("violations").cast("bigint").alias("violations"), "passed")


@query(
    "validate_pages",
    """SELECT page_id, 'url' AS field, 'regex' AS rule,
  'Field ''url'' does not match pattern ''https://.*''.' AS message FROM pages
WHERE NOT regexp_full_match(url, 'https://.*')""",
)
def validate_pages(spark, folder):
    rules = [C.ValidationRule("url", "required"), C.ValidationRule("url", "regex", "https://.*")]
    return C.violation_rows(C.validate_records(D.table(spark, folder, "pages"), rules), ["page_id"])


@query(
    "validate_rule_table",
    """SELECT c_custkey, 'c_acctbal' AS field, 'min' AS rule, 'Field ''c_acctbal'' must be >= 0.0, got ' || c_acctbal || '.' AS message
  FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_acctbal', 'max', 'Field ''c_acctbal'' must be <= 9000.5, got ' || c_acctbal || '.' FROM customer WHERE c_acctbal > 9000.5
UNION ALL SELECT c_custkey, 'c_mktsegment', 'regex', 'unexpected segment' FROM customer
  WHERE NOT regexp_full_match(c_mktsegment, 'BUILDING|MACHINERY|HOUSE.*')
UNION ALL SELECT c_custkey, 'c_name', 'type', 'Field ''c_name'' must be int, got string.' FROM customer WHERE c_name IS NOT NULL
UNION ALL SELECT c_custkey, 'c_email', 'required', 'Field ''c_email'' is required.' FROM customer""",
)
def validate_rule_table(spark, folder):
    """The rules as a table: every kind, and fields that the records do not have."""
    rules = rule_table(
        spark,
        "rule_idx int, field string, rule string, value string, message string",
        [
            (1, "c_acctbal", "min", "0", None),
            (2, "c_acctbal", "max", "9000.5", None),
            (3, "c_mktsegment", "regex", "BUILDING|MACHINERY|HOUSE.*", "unexpected segment"),
            (4, "c_name", "type", "int", None),
            (5, "c_nationkey", "type", "int", None),
            (6, "c_email", "required", None, None),
            (7, "c_email", "min", "1", None),
        ],
    )
    return C.violations_by_table(D.table(spark, folder, "customer"), rules, ["c_custkey"])


@query(
    "validate_json_records",
    """WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_id, 'k' AS field, 'max' AS rule, 'Field ''k'' must be <= 50.0, got ' || k || '.' AS message FROM r WHERE k > 50
UNION ALL SELECT event_id, 'k', 'type', 'k is not text' FROM r WHERE k IS NOT NULL
UNION ALL SELECT event_id, 'name', 'required', 'Field ''name'' is required.' FROM r""",
)
def validate_json_records(spark, folder):
    rules = [
        C.ValidationRule("k", "max", 50.0),
        C.ValidationRule("k", "type", "int"),
        C.ValidationRule("k", "type", "str", "k is not text"),
        C.ValidationRule("name", "required"),
    ]
    e = D.table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("r"))
    return C.violation_rows(C.validate_records(e, rules, record="r"), ["event_id"])


@query(
    "watermark_lag",
    f"""{with_tables('alert_event')}, w AS (SELECT pipeline, max(triggered_at) AS m FROM alert_event GROUP BY 1),
n AS (SELECT DISTINCT 'p' || (c_custkey % 40) AS pipeline FROM customer),
l AS (SELECT n.pipeline, coalesce(m, TIMESTAMP '2024-01-30 12:00:00') AS current_watermark,
  greatest(0.0, coalesce((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(m)) / 1000000.0::DOUBLE, 0.0))::DOUBLE AS lag_seconds
  FROM n LEFT JOIN w USING (pipeline))
SELECT *, lag_seconds > 7200 AS breached FROM l""",
)
def watermark_lag(spark, folder):
    pipelines = (
        D.table(spark, folder, "customer")
        .select(F.concat(F.lit("p"), (F.col("c_custkey") % 40).cast("string")).alias("pipeline"))
        .distinct()
    )
    return C.watermark_lag(pipelines, D.alert_events(spark, folder), "2024-01-30 12:00:00", 7200)


@query(
    "dependency_block",
    f"""{with_tables('edge')}, bad AS (SELECT printf('n%02d', c_nationkey) AS p FROM customer GROUP BY 1
  HAVING avg(c_acctbal) < 4300),
u AS (SELECT downstream, string_agg(upstream, ',' ORDER BY upstream) AS b FROM edge
  WHERE upstream IN (SELECT p FROM bad) GROUP BY 1),
n AS (SELECT upstream AS pipeline FROM edge UNION SELECT downstream FROM edge)
SELECT pipeline, coalesce(b, '') AS blocking, b IS NOT NULL AS blocked FROM n LEFT JOIN u ON pipeline = downstream""",
)
def dependency_block(spark, folder):
    failed = (
        D.table(spark, folder, "customer")
        .groupBy(F.format_string("n%02d", F.col("c_nationkey")).alias("pipeline"))
        .agg(F.avg("c_acctbal").alias("a"))
        .filter("a < 4300")
    )
    out = C.dependency_block(D.edges(spark, folder), failed)
    return out.withColumn("blocking", F.array_join("blocking", ","))


@query(
    "schema_drift",
    """WITH b AS (SELECT month(ts) * 100 + day(ts) - 101 AS batch, * FROM events),
c AS (SELECT batch, unnest([{'c': 'value', 't': 'double', 'n': count(CASE WHEN event_type = 'error' AND value < 300 THEN NULL ELSE value END)},
   {'c': 'big', 't': CASE WHEN batch % 7 < 3 THEN 'int' ELSE 'bigint' END, 'n': count(CASE WHEN value > 200 THEN user_id END)}]) AS s FROM b GROUP BY batch),
k AS (SELECT batch, s.c AS "column", s.t AS "type" FROM c WHERE s.n > 0),
j AS (SELECT coalesce(o.batch + 1, n.batch) AS batch, coalesce(o."column", n."column") AS "column",
   o."type" AS old_type, n."type" AS new_type
  FROM k o FULL JOIN k n ON o.batch + 1 = n.batch AND o."column" = n."column")
SELECT batch, "column", CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change,
  old_type, new_type FROM j
WHERE batch > (SELECT min(batch) FROM k) AND batch <= (SELECT max(batch) FROM k) AND old_type IS DISTINCT FROM new_type""",
)
def schema_drift(spark, folder):
    e = D.table(spark, folder, "events")
    batch = F.month("ts") * 100 + F.dayofmonth("ts") - 101
    seen = e.select(
        "ts",
        F.when(~((F.col("event_type") == "error") & (F.col("value") < 300)), F.col("value")).alias("value"),
        F.when(F.col("value") > 200, F.col("user_id")).alias("big"),
    )
    catalog = C.batch_catalog(seen.select(F.col("value"), F.col("big"), batch.alias("b")), F.col("b")).filter(
        "column <> 'b'"
    )
    kind = F.when((F.col("column") == "big") & (F.col("batch") % 7 < 3), "int").otherwise(F.col("type"))
    out = C.schema_drift(catalog.withColumn("type", kind))
    return out.withColumn("batch", F.col("batch").cast("bigint"))


METRIC_RULES = [
    (1, "low qty", None, "F", "lt", 20.0, "critical"),
    (2, "high qty", None, "O", "gt", 31.0, "warning"),
    (3, "A at least", "A", "F", "gte", 30.0, "info"),
    (4, "N at most", "N", "O", "lte", 21.0, "warning"),
    (5, "exact", None, "F", "eq", 25.0, "info"),
]
METRIC_RULE_SCHEMA = (
    "rule_idx int, name string, pipeline string, metric string, operator string, threshold double, severity string"
)
METRIC_RULE_VALUES = ", ".join(
    "({}, '{}', {}, '{}', '{}', {}::DOUBLE, '{}')".format(
        r[0], r[1], "NULL" if r[2] is None else f"'{r[2]}'", *r[3:]
    )
    for r in METRIC_RULES
)


@query(
    "metric_rules",
    f"""{with_tables('metric')}, rule(rule_idx, rule_name, p, m, operator, threshold, severity) AS (VALUES {METRIC_RULE_VALUES})
SELECT pipeline, metric, rule_name, severity, value, operator, threshold, recorded_at FROM metric JOIN rule
ON metric = m AND (p IS NULL OR p = pipeline) AND CASE operator WHEN 'gt' THEN value > threshold WHEN 'lt' THEN value < threshold
  WHEN 'gte' THEN value >= threshold WHEN 'lte' THEN value <= threshold WHEN 'eq' THEN value = threshold ELSE false END""",
)
def metric_rules(spark, folder):
    rules = rule_table(spark, METRIC_RULE_SCHEMA, METRIC_RULES)
    return C.metric_alerts(D.metrics(spark, folder), rules)


STATUS_RULES = [
    ("on error", "error", ["fail"], "critical", None),
    ("on click", "click", ["fail", "error"], "warning", "clicks look wrong"),
    ("on any", "purchase", ["pass", "fail"], "info", ""),
    ("on none", "no such check", ["fail"], "info", None),
]
STATUS_SQL = """rule(rule_name, c, on_status, severity, text) AS (VALUES
  ('on error', 'error', ['fail'], 'critical', NULL), ('on click', 'click', ['fail', 'error'], 'warning', 'clicks look wrong'),
  ('on any', 'purchase', ['pass', 'fail'], 'info', ''), ('on none', 'no such check', ['fail'], 'info', NULL))"""


def _status_rules(spark):
    return rule_table(
        spark, "name string, check_name string, on_status array<string>, severity string, message string", STATUS_RULES
    )


@query(
    "status_rules",
    f"""{with_tables('alert_event')}, {STATUS_SQL},
last AS (SELECT check_name, max_by(status, (triggered_at, event_id)) AS status, max_by(message, (triggered_at, event_id)) AS message
  FROM alert_event GROUP BY 1)
SELECT rule_name, check_name, severity, status, CASE WHEN length(text) > 0 THEN text
  ELSE '[' || upper(status) || '] ' || check_name || ': ' || message END AS message
FROM last JOIN rule ON check_name = c AND list_contains(on_status, status)""",
)
def status_rules(spark, folder):
    e = D.alert_events(spark, folder).select("check_name", "status", "message", "triggered_at", "event_id")
    return C.status_alerts(e, _status_rules(spark), ["triggered_at", "event_id"])


@query(
    "run_report",
    f"""{with_tables('alert_event')}, r AS (SELECT pipeline || '-' || strftime(triggered_at, '%Y%m%d') AS run_id, * FROM alert_event),
t AS (SELECT run_id, count(*) AS total, count(*) FILTER (status <> 'pass') AS failed,
  count(*) FILTER (NOT passed AND severity <> 'info') AS alerts FROM r GROUP BY 1)
SELECT run_id, total, failed, alerts, failed = 0 AS passed,
  'Run ' || CASE WHEN failed = 0 THEN 'PASSED' ELSE 'FAILED' END || ': ' || (total - failed) || '/' || total
  || ' checks passed, ' || alerts || ' alert(s) triggered' AS summary FROM t""",
)
def run_report(spark, folder):
    run = F.concat(F.col("pipeline"), F.lit("-"), F.date_format("triggered_at", "yyyyMMdd"))
    r = D.alert_events(spark, folder).withColumn("run_id", run)
    return C.run_report(r, r.filter("not passed and severity <> 'info'"))


@query(
    "run_summary",
    f"""{with_tables('alert_event')}, r AS (SELECT strftime(triggered_at, '%Y%m%d') AS run_id, * FROM alert_event)
SELECT run_id, event_id AS line_no, rpad(check_name, 30, ' ') || ' ' || rpad(CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END, 8, ' ') || ' '
  || rpad(CAST(value AS VARCHAR), 15, ' ') || ' ' || rpad('lt ' || CAST(threshold AS VARCHAR), 15, ' ') || ' ' || severity AS line FROM r
UNION ALL SELECT run_id, NULL, 'Total: ' || count(*) || '  Passed: ' || count(*) FILTER (passed) || '  Failed: ' || count(*) FILTER (NOT passed)
  || '  Overall result: ' || CASE WHEN bool_and(passed) THEN 'PASSED' ELSE 'FAILED' END FROM r GROUP BY 1""",
)
def run_summary(spark, folder):
    r = D.alert_events(spark, folder)
    return C.run_summary(
        r.select(
            F.date_format("triggered_at", "yyyyMMdd").alias("run_id"),
            F.col("event_id").alias("line_no"),
            "check_name", "passed", "value", F.lit("lt").alias("operator"), "threshold", "severity",
        )
    )


def split_metrics(spark, folder):
    """Baselines: each series' last value before 1998; current: its last value."""
    m = D.metrics(spark, folder)
    keys = ["pipeline", "metric"]
    base = O.latest_per_key(m.filter("recorded_at < timestamp_ntz'1998-01-01'"), keys, ["recorded_at"], ["value", "recorded_at"])
    now = O.latest_per_key(m, keys, ["recorded_at"], ["value", "recorded_at"])
    return base, now


SPLIT_SQL = f"""{with_tables('metric')},
base AS (SELECT pipeline, metric, max_by(value, recorded_at) AS b FROM metric WHERE recorded_at < TIMESTAMP '1998-01-01' GROUP BY ALL),
cur AS (SELECT pipeline, metric, max_by(value, recorded_at) AS v FROM metric GROUP BY ALL),
drift AS (SELECT pipeline, metric, b AS baseline_value, v AS current_value, v - b AS delta,
  CASE WHEN b <> 0 THEN (v - b) / abs(b) * 100 END AS pct_change FROM cur JOIN base USING (pipeline, metric))"""


@query("baseline_drift", f"{SPLIT_SQL} SELECT *, coalesce(abs(pct_change) > 10, false) AS drifted FROM drift")
def baseline_drift(spark, folder):
    base, now = split_metrics(spark, folder)
    return C.baseline_drift(now, base)


@query(
    "gate",
    f"""{SPLIT_SQL}, {D.ORACLE_CTES['history']}, {D.ORACLE_CTES['alert_event']},
lp AS (SELECT pipeline, max((recorded_at, run_id)) FILTER (passed) AS lp FROM history GROUP BY 1),
st AS (SELECT h.pipeline, count(*) FILTER (lp IS NULL OR (recorded_at, run_id) > lp) AS s FROM history h JOIN lp USING (pipeline) GROUP BY 1),
g AS (SELECT 'drift' AS gate, count(*) AS checked, count(*) FILTER (abs(pct_change) > 10) AS bad FROM drift
 UNION ALL SELECT 'streak', count(*), count(*) FILTER (s >= 3) FROM st
 UNION ALL SELECT 'checks', count(*), count(*) FILTER (NOT passed) FROM alert_event)
SELECT *, bad > 0 AS closed FROM g""",
)
def gate(spark, folder):
    base, now = split_metrics(spark, folder)
    streaks = O.current_streaks(
        D.history(spark, folder), ["pipeline"], ["recorded_at", "run_id"], "run_id"
    )
    return C.gate(
        {
            "drift": (C.baseline_drift(now, base), F.col("drifted")),
            "streak": (streaks, F.col("streak") >= 3),
            "checks": (D.alert_events(spark, folder), ~F.col("passed")),
        }
    )
