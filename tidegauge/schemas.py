"""Canonical table schemas (DDL strings)."""

ALERT_EVENT = (
    "event_id bigint, pipeline string, check_name string, rule_name string, severity string, "
    "status string, passed boolean, value double, threshold double, message string, "
    "tags array<string>, metadata map<string,string>, triggered_at timestamp"
)
CHECK_RESULT = (
    "run_id string, pipeline string, check_name string, status string, message string, "
    "value double, threshold double, metadata map<string,string>"
)
RULE = (
    "rule_idx int, name string, pipeline string, check_name string, metric string, "
    "operator string, threshold double, severity string, on_status array<string>, "
    "message string, tags array<string>"
)
HISTORY = (
    "run_id string, pipeline string, check_name string, metric string, value double, "
    "passed boolean, status string, total_checks bigint, failed_checks bigint, "
    "alert_count bigint, recorded_at timestamp"
)
METRIC = "pipeline string, metric string, value double, recorded_at timestamp"
PROFILE_SAMPLE = (
    "sample_id bigint, pipeline string, check_name string, duration_ms double, recorded_at timestamp"
)
SPAN = (
    "trace_id string, span_id string, parent_span_id string, pipeline string, check_name string, "
    "status string, tags map<string,string>, started_at timestamp, ended_at timestamp"
)
EDGE = "upstream string, downstream string"
