"""Edge cases of single operators on hand-made tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegauge.functions import metrics as M
from tidegauge.functions.common import glob_regex
from tidegauge.operators import aggregates as A
from tidegauge.operators import checks as C
from tidegauge.operators import enrich as E
from tidegauge.operators import filters as R
from tidegauge.operators import fold as K
from tidegauge.operators import graph as N
from tidegauge.operators import limits as L
from tidegauge.operators import ordered as O
from tidegauge.operators.windows import build_windows
from tidegauge.sources import stores as S

T0 = datetime(2024, 1, 1)
EVENT = (
    "event_id bigint, pipeline string, check_name string, severity string, status string, passed boolean, "
    "tags array<string>, triggered_at timestamp_ntz"
)


def event(i, minutes=0, pipeline="p", check="c", severity="info", passed=True, tags=()):
    at = T0 + timedelta(minutes=minutes)
    return (i, pipeline, check, severity, "pass" if passed else "fail", passed, list(tags) if tags is not None else None, at)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def column(df, name, by="event_id"):
    return [r[name] for r in df.orderBy(by).collect()]


# Checks


@pytest.mark.parametrize("n,lo,hi,status", [(5, 5, 5, "pass"), (4, 5, None, "fail"), (6, None, 5, "fail"), (0, None, None, "pass"), (0, 1, None, "fail")])
def test_row_count(spark, n, lo, hi, status):
    r = one(C.row_count_checks(spark.range(n), min_count=lo, max_count=hi))
    assert (r.status, r.value) == (status, n)
    assert r.threshold == (None if status == "pass" else float(lo if lo and n < lo else hi))


def test_null_rate_of_no_rows_is_an_error(spark):
    r = one(C.null_rate_checks(spark.range(0), ["id"]))
    assert (r.status, r.value) == ("error", None)


def test_null_rate_equal_to_the_limit_passes(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    assert one(C.null_rate_checks(df, ["x"], 0.5)).status == "pass"
    assert one(C.null_rate_checks(df, ["x"], 0.49)).status == "fail"


@pytest.mark.parametrize("limit,status", [(3600, "pass"), (3599, "fail")])
def test_freshness_boundary(spark, limit, status):
    df = events(spark, event(1))
    r = one(C.freshness_checks(df, "triggered_at", "2024-01-01 01:00:00", limit))
    assert (r.status, r.value) == (status, 3600.0)


def test_validation_rules(spark):
    df = spark.createDataFrame([(1, "", 5, "ab\n"), (2, None, None, None), (3, "x", 10, "ab")], "id int, name string, n int, code string")
    rules = [
        C.ValidationRule("name", "required"),
        C.ValidationRule("n", "min", 6),
        C.ValidationRule("n", "max", 9, "too big"),
        C.ValidationRule("code", "regex", "a|ab"),
        C.ValidationRule("n", "type", "no such type"),
    ]
    out = C.violation_rows(C.validate_records(df, rules), ["id"]).collect()
    found = sorted((r.id, r.field, r.rule) for r in out)
    assert found == [(1, "code", "regex"), (1, "n", "min"), (1, "name", "required"), (2, "name", "required"), (3, "n", "max")]
    assert {r.message for r in out if r.id == 3} == {"too big"}
    with pytest.raises(ValueError):
        C.ValidationRule("x", "nope")


def test_variant_types(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 1.5}',), ('{"a": true}',), ('{"a": "s"}',), ('{"a": null}',)], "j string")
    df = df.select("j", F.parse_json("j").alias("r"))
    bad = lambda kind: {
        r.j for r in C.validate_records(df, [C.ValidationRule("a", "type", kind)], "r").filter("not passed").collect()
    }
    assert bad("int") == {'{"a": 1.5}', '{"a": "s"}'}
    assert bad("float") == {'{"a": 1}', '{"a": true}', '{"a": "s"}'}
    assert bad("bool") == {'{"a": 1}', '{"a": 1.5}', '{"a": "s"}'}
    assert bad("str") == {'{"a": 1}', '{"a": 1.5}', '{"a": true}'}


def test_rules_are_checked(spark):
    rules = spark.createDataFrame([("r", "gt", 1.0, None)], "name string, operator string, threshold double, severity string")
    assert one(C.check_rules(rules)).severity == "warning"
    for bad in (("r", "above", 1.0, "info"), ("r", "gt", 1.0, "fatal"), ("r", None, 1.0, "info")):
        with pytest.raises(PySparkException):
            C.check_rules(spark.createDataFrame([bad], rules.schema)).collect()


def test_lag_of_unknown_pipeline_is_zero(spark):
    names = spark.createDataFrame([("p",), ("q",)], "pipeline string")
    out = {r.pipeline: r for r in C.watermark_lag(names, events(spark, event(1)), "2024-01-01 00:10:00").collect()}
    assert (out["p"].lag_seconds, out["p"].breached) == (600.0, True)
    assert (out["q"].lag_seconds, out["q"].breached) == (0.0, False)


def test_drift_against_zero_baseline(spark):
    b = spark.createDataFrame([("p", "m", 0.0), ("p", "n", -10.0)], "pipeline string, metric string, value double")
    now = spark.createDataFrame([("p", "m", 5.0), ("p", "n", -8.0), ("p", "new", 1.0)], b.schema)
    out = {r.metric: (r.pct_change, r.drifted) for r in C.baseline_drift(now, b).collect()}
    assert out == {"m": (None, False), "n": (20.0, True)}


def test_schema_drift(spark):
    cat = spark.createDataFrame([(1, "a", "int"), (1, "b", "int"), (2, "a", "bigint"), (2, "c", "int")], "batch int, column string, type string")
    assert {(r.batch, r.column, r.change) for r in C.schema_drift(cat).collect()} == {(2, "a", "type_changed"), (2, "b", "removed"), (2, "c", "added")}


# Filters and routing


def test_acceptance_of_no_rows_is_one(spark):
    flagged = R.filter_chain(events(spark), [("x", F.col("passed"), "include")])
    assert one(R.acceptance(flagged)).rate == 1.0
    with pytest.raises(ValueError):
        R.filter_chain(events(spark), [("x", F.lit(True), "maybe")])


def test_tags(spark):
    df = events(spark, event(1, tags=["a", "b"]), event(2, tags=None), event(3, tags=["b"]))
    ids = lambda d: [r.event_id for r in d.orderBy("event_id").collect()]
    assert ids(R.tag_filter(df)) == [1, 2, 3]
    assert ids(R.tag_filter(df, ["b"])) == [1, 3]
    assert ids(R.tag_filter(df, ["b"], ["a"])) == [3]
    assert {(r.tag, r["count"]) for r in A.group_by_tag(df).collect()} == {("a", 1), ("b", 2), ("(untagged)", 1)}


@pytest.mark.parametrize(
    "glob,text,hit",
    [("*", "", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("a.c", "abc", False),
     ("a[", "a[", True), ("a+b*", "a+bc", True), ("A", "a", False), ("a|b", "a", False), ("x*", "x\ny", True)],
)
def test_globs(spark, glob, text, hit):
    df = spark.createDataFrame([(glob, text)], "g string, t string")
    assert one(df.select(F.regexp_like("t", glob_regex("g")).alias("hit"))).hit is hit


def test_silence_and_maintenance_boundaries(spark):
    df = events(spark, event(1, 0), event(2, 10), event(3, 20))
    rule = "rule_idx int, pipeline_glob string, check_glob string, expires_at timestamp_ntz"
    rules = spark.createDataFrame([(1, "p", "c", T0)], rule)
    assert R.silence(df, rules, "2024-01-01 00:00:00").count() == 3
    assert R.silence(df, rules, "2023-12-31 23:59:59").count() == 0
    w = spark.createDataFrame([("p", T0, T0 + timedelta(minutes=10))], "pipeline string, start_at timestamp_ntz, end_at timestamp_ntz")
    assert [r.event_id for r in R.in_maintenance(df, w).collect()] == [3]
    assert R.in_maintenance(df, w, suppressed=True).count() == 2


@pytest.mark.parametrize("limit", [100, 0])
def test_routing_small_and_large_rule_tables(spark, limit):
    """Both ways of matching rules give the same channels."""
    df = events(spark, event(1, pipeline="p1", severity="critical"), event(2, pipeline="p2", tags=["x"]), event(3, pipeline=None, severity=None))
    rules = spark.createDataFrame(
        [(1, "p1", None, None, "one"), (2, None, "critical", [], "pager"), (3, "", None, ["x", "y"], "tagged")],
        "rule_idx int, pipeline string, severity string, tags array<string>, channel string",
    )
    assert column(R.route(df, rules, limit=limit), "channels") == [["one", "pager"], ["tagged"], ["default"]]


@pytest.mark.parametrize("limit", [100, 0])
def test_labels(spark, limit):
    schema = "rule_idx int, pipeline string, severity string, key string, value string"
    rules = spark.createDataFrame([(1, None, None, "k", "a"), (2, "p", None, "k", "b"), (3, "p", "info", "j", "c")], schema)
    df = events(spark, event(1), event(2, pipeline="q"))
    assert column(E.label(df, rules, limit), "labels") == [{"k": "b", "j": "c"}, {"k": "a"}]
    with pytest.raises(Exception, match="label key must not be empty"):
        E.label(df, spark.createDataFrame([(1, None, None, "", "a")], schema)).collect()


def test_sampling_is_stable_and_about_right(spark):
    df = spark.range(20_000).withColumnRenamed("id", "event_id")
    a = R.sample(df, 0.25, seed=1).filter("sampled")
    assert abs(a.count() / 20_000 - 0.25) < 0.02
    b = R.sample(df.repartition(7), 0.25, seed=1).filter("sampled")
    assert a.exceptAll(b).count() == 0
    assert R.sample(df, 1.0).filter("not sampled").count() == 0
    with pytest.raises(ValueError):
        R.sample(df, 0)


def test_archive_treats_bad_times_as_old(spark):
    df = spark.createDataFrame([("2024-01-08T00:00:00",), ("2024-01-07T23:59:59",), ("nonsense",), (None,)], "at string")
    out = R.archive_flag(df, "at", "2024-01-15 00:00:00").collect()
    assert [r.archived for r in out] == [False, True, True, True]


@pytest.mark.parametrize(
    "expression,n",
    [("*/15 * * * *", 96 * 7 + 1), ("@daily", 8), ("@midnight", 8), ("@weekly", 2), ("5 1-3 * * 0", 3), ("0 0 1 1 *", 1), ("0 0 * 2 *", 0)],
)
def test_schedules(spark, expression, n):
    """2024-01-01 is a Monday, day-of-week 0."""
    s = spark.createDataFrame([("s", "p", expression)], "name string, pipeline string, expression string")
    assert R.due_minutes(s, "2024-01-01 00:00:00", "2024-01-08 00:00:00").count() == n


# Columns


def test_transforms(spark):
    df = spark.createDataFrame([(-2.7,), (0.5,), (2.5,)], "v double")
    got = lambda fn: [r[0] for r in df.select(M.transformed("v", fn)).collect()]
    assert got("round") == [-3.0, 0.0, 2.0]
    assert got("floor") == got("ceil") == [-2.0, 0.0, 2.0]
    assert got("true_floor") == [-3.0, 0.0, 2.0]
    assert got("log10")[0] == 0.0 and got("sqrt")[0] == 0.0
    for bad in ({"fn": "nope"}, {"scale": 0}):
        with pytest.raises(ValueError):
            M.transformed("v", **bad)


def test_masking_is_case_insensitive(spark):
    df = spark.createDataFrame([({"API-Key": "1", "my_Password_2": "2", "name": "3"},)], "metadata map<string,string>")
    r = one(E.mask_metadata(df))
    assert r.metadata == {"API-Key": "***", "my_Password_2": "***", "name": "3"}
    assert r.masked_keys == ["API-Key", "my_Password_2"]
    with pytest.raises(ValueError):
        E.redact_metadata(df, [])


def test_fingerprint_is_the_hash_of_sorted_json(spark):
    import hashlib
    import json

    df = events(spark, event(1, pipeline='q"\\', check="é"))
    text = json.dumps({"check": "é", "pipeline": 'q"\\', "severity": "info"}, sort_keys=True)
    assert one(df.select(E.fingerprint().alias("d"))).d == hashlib.sha256(text.encode()).hexdigest()


def test_normalize_edges(spark):
    schema = "rule_idx int, metric string, strategy string, min_val double, max_val double, clamp_low double, clamp_high double"
    rules = spark.createDataFrame([(1, "a", "minmax", 1.0, 1.0, None, None), (2, "b", "zscore", 0.0, 1.0, None, None), (3, "c", "clamp", 0.0, 1.0, None, 3.0)], schema)
    m = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0), ("none", 5.0)], "metric string, value double")
    hist = spark.createDataFrame([("b", 5.0)], "metric string, value double")
    out = {r.metric: r.normalized for r in E.normalize(m, rules, hist).collect()}
    assert out == {"a": 0.0, "b": 0.0, "c": 3.0}


# Aggregates


def test_score_bounds(spark):
    df = events(spark, *[event(i, severity="CRITICAL") for i in range(3)], event(9, pipeline="q", severity="odd"))
    df = df.withColumn("rule_name", F.lit("r"))
    out = {r.pipeline: r for r in A.health_score(df).collect()}
    assert (out["p"].score, out["p"].healthy, out["p"].deductions) == (0, False, ["r(-40) x3"])
    assert (out["q"].score, out["q"].healthy, out["q"].pct, out["q"].deductions) == (100, True, 100.0, [])


def test_trend_streak(spark):
    marks = "PPFPFF"
    rows = [(i, "p", "PASS" if m == "P" else "FAIL", T0 + timedelta(hours=i)) for i, m in enumerate(marks)]
    h = spark.createDataFrame(rows, "run_id int, pipeline string, status string, recorded_at timestamp_ntz")
    r = one(A.trend(h))
    assert (r.total_runs, r.passed_runs, r.consecutive_failures, r.last_status) == (6, 3, 2, "FAIL")
    r = one(A.trend(h, 2))
    assert (r.total_runs, r.consecutive_failures, r.pass_rate) == (2, 2, 0.0)


def test_correlation_of_constant_and_short_series(spark):
    rows = [(i, p, ok, T0 + timedelta(hours=i)) for p, s in {"a": [1, 0, 1], "b": [1, 1, 1], "c": [0, 1, 0, 0], "d": [1]}.items() for i, ok in enumerate(bool(x) for x in s)]
    h = spark.createDataFrame(rows, "run_id int, pipeline string, passed boolean, recorded_at timestamp_ntz")
    out = {(r.pipeline_a, r.pipeline_b): (r.score, r.sample_size) for r in A.correlate(h).collect()}
    # Newest first: a = 1 0 1, b = 1 1 1, c = 0 0 1 (0); d is too short.
    assert out == {("a", "b"): (0.0, 3), ("a", "c"): (0.5, 3), ("b", "c"): (0.0, 3)}


def test_anomaly_needs_two_points(spark):
    schema = "pipeline string, metric string, value double"
    now = spark.createDataFrame([("p", "none", 7.0), ("p", "one", 7.0), ("p", "flat", 7.0), ("p", "far", 500.0)], schema)
    past = [("p", "one", 3.0), ("p", "flat", 5.0), ("p", "flat", 5.0)] + [("p", "far", x) for x in (100.0, 102.0, 98.0, 101.0, 99.0)]
    out = {r.metric: (r["mean"], r.z_score, r.is_anomaly) for r in A.anomalies(now, spark.createDataFrame(past, schema)).collect()}
    assert out["none"] == (7.0, 0.0, False) and out["one"] == (3.0, 0.0, False) and out["flat"] == (5.0, 0.0, False)
    assert out["far"][2] and out["far"][1] > 200


def test_forecast_of_a_line_and_of_too_few_points(spark):
    rows = [("p", "m", 2.0 * h + 10, T0 + timedelta(hours=h)) for h in range(5)] + [("p", "few", 1.0, T0)]
    rows += [("p", "same_time", float(i), T0) for i in range(3)]
    m = spark.createDataFrame(rows, "pipeline string, metric string, value double, recorded_at timestamp_ntz")
    out = {r.metric: r for r in A.forecast(m, 6).collect()}
    assert (out["m"].predicted_value, out["m"].confidence) == (30.0, 1.0)
    assert out["few"].predicted_value != out["few"].predicted_value
    assert out["few"].warning == "insufficient history (1/3 points)"
    assert (out["same_time"].predicted_value, out["same_time"].confidence) == (1.0, 0.0)
    assert {r.metric for r in A.project(m).collect()} == {"m", "same_time"}
    with pytest.raises(ValueError):
        A.project(m, 0)


def test_profile_of_one_sample(spark):
    df = spark.createDataFrame([(1, "p", "c", 5.0)], "sample_id int, pipeline string, check_name string, duration_ms double")
    r = one(A.profile_report(df))
    assert (r["count"], r.mean_ms, r.p95_ms, r.stdev_ms) == (1, 5.0, 5.0, None)


# Order


def test_debounce_fires_on_every_later_failure(spark):
    marks = "FFFPFF"
    df = events(spark, *[event(i, i, passed=m == "P") for i, m in enumerate(marks)])
    assert column(O.debounce(df, 2), "fires") == [False, True, True, False, False, True]


def test_throttle_with_cap(spark):
    df = events(spark, *[event(i, m) for i, m in enumerate([0, 10, 20, 30, 100, 110])])
    assert column(O.throttle(df, 30, 2), "throttled") == [False, True, True, False, False, True]
    assert column(O.throttle(df, 30), "suppressed_count") == [0, 1, 2, 3, 0, 1]


def test_cooldown_counts_from_the_last_fired(spark):
    df = events(spark, *[event(i, m) for i, m in enumerate([0, 20, 30, 59, 60])])
    assert column(K.dedupe(df, 30), "fired") == [True, False, True, False, True]


def test_quota_lower_end_is_inside(spark):
    df = events(spark, *[event(i, m) for i, m in enumerate([0, 1, 60, 61, 62])])
    out = K.quota(df, 2, 60)
    assert column(out, "allowed") == [True, True, False, True, True]
    assert column(out, "current_count") == [1, 2, 2, 2, 2]


def test_backoff_first_gap_is_the_second_delay(spark):
    df = events(spark, *[event(i, m) for i, m in enumerate([0, 1, 2, 5, 6, 100])])
    assert column(K.backoff(df, 60, 2, 3600, 3), "due") == [True, False, True, False, True, False]


def test_breaker_reopens_from_half_open(spark):
    marks = [(0, "F"), (1, "F"), (2, "P"), (12, "F"), (13, "P"), (23, "P"), (24, "F")]
    df = events(spark, *[event(i, m, passed=x == "P") for i, (m, x) in enumerate(marks)])
    out = K.circuit_breaker(df, 2, 600)
    assert column(out, "state") == ["closed", "closed", "open", "half_open", "open", "half_open", "closed"]
    assert column(out, "failures") == [1, 2, 2, 3, 3, 0, 1]


def test_batches_close_by_size_and_age(spark):
    df = events(spark, *[event(i, m) for i, m in enumerate([0, 0, 0, 1, 5, 6])])
    out = K.batches(K.batch(df, 3, 120), 3).orderBy("batch_no").collect()
    assert [(r["size"], r.reason) for r in out] == [(3, "size"), (2, "age"), (1, "manual")]


def test_compaction_keeps_failures(spark):
    marks = [(0, "P"), (1, "P"), (2, "F"), (3, "P"), (4, "P"), (9, "P")]
    rows = [event(i, m, passed=x == "P") for i, (m, x) in enumerate(marks)]
    df = events(spark, *rows)
    order = ("triggered_at", "event_id")
    kept = K.compact(df, 60, 1000, order=order)
    assert [r.event_id for r in kept.orderBy("event_id").collect()] == [0, 2, 3, 5]
    assert [r.event_id for r in K.compact(df, 60, 2, order=order).orderBy("event_id").collect()] == [2, 5]
    assert [r.event_id for r in K.compact(df, 60, 2, False, order).orderBy("event_id").collect()] == [3, 5]
    assert one(K.compaction_stats(df, kept)).reduction_pct == 33.33
    assert one(K.compaction_stats(df.limit(0), df.limit(0))).reduction_pct == 0.0


def test_escalation_boundaries(spark):
    rows = [(i, "p", "c", False, T0 + timedelta(hours=i)) for i in range(4)]
    h = spark.createDataFrame(rows, "run_id int, pipeline string, check_name string, passed boolean, recorded_at timestamp_ntz")
    pol = spark.createDataFrame([("p", "c", 5, 1), ("p", "c", 3, 1), ("p", "c", 3, 2), ("p", "c", 2, 2), ("q", "c", 1, 1)], "pipeline string, check_name string, threshold int, notify_every int")
    out = {(r.pipeline, r.threshold, r.notify_every): r.escalate for r in O.escalation(h, pol).collect()}
    assert out == {("p", 5, 1): False, ("p", 3, 1): True, ("p", 3, 2): False, ("p", 2, 2): True, ("q", 1, 1): False}


# Windows, pages, graph


def test_windows_have_empty_buckets_and_start_at_the_first_event(spark):
    df = events(spark, event(1, 3), event(2, 14, severity="critical"), event(3, 13))
    out = build_windows(df, "2024-01-01 00:20:00", 300).orderBy("start_at").collect()
    assert [(r["count"], r.failure_count) for r in out] == [(1, 0), (0, 0), (2, 1), (0, 0)]
    assert out[0].start_at == T0 + timedelta(minutes=3)
    slide = build_windows(df, "2024-01-01 00:15:00", 600, 300).orderBy("start_at").collect()
    assert [r["count"] for r in slide] == [1, 2, 2]
    assert build_windows(events(spark), "2024-01-01 00:20:00").count() == 0
    assert build_windows(df, "2024-01-01 00:03:00").count() == 0
    with pytest.raises(ValueError):
        build_windows(df, "2024-01-01 00:20:00", 300, 600)


def test_pages(spark):
    df = spark.range(45)
    assert [r.id for r in L.page(df, ["id"], 3, 20).collect()] == [40, 41, 42, 43, 44]
    assert [r.id for r in L.page_after(df, ["id"], [41], 20).collect()] == [42, 43, 44]
    info = one(L.page_info(df, 3, 20))
    assert (info.total_pages, info.has_next, info.has_prev) == (3, False, True)
    assert one(L.page_info(spark.range(0))).total_pages == 1
    for bad in ((0, 20), (1, 0), (1, 501)):
        with pytest.raises(ValueError):
            L.page(df, ["id"], *bad)


@pytest.mark.parametrize(
    "pairs,cyclic",
    [([], False), ([("a", "b"), ("b", "c")], False), ([("a", "a")], True), ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], True), ([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], False)],
)
def test_cycles(spark, pairs, cyclic):
    edges = spark.createDataFrame(pairs, "upstream string, downstream string")
    assert one(N.has_cycle(edges)).has_cycle is cyclic


def test_dependency_block(spark):
    edges = spark.createDataFrame([("ingest", "transform"), ("transform", "export")], "upstream string, downstream string")
    failed = spark.createDataFrame([("ingest",)], "pipeline string")
    out = {r.pipeline: (r.blocking, r.blocked) for r in C.dependency_block(edges, failed).collect()}
    assert out == {"ingest": ([], False), "transform": (["ingest"], True), "export": ([], False)}


# Stores


def test_json_rules_and_history_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text('[{"name": "r", "metric": "m", "operator": "gt", "threshold": 3}]')
    r = one(S.read_rules(spark, str(tmp_path / "rules.json")))
    assert (r.severity, r.threshold, r.operator) == ("warning", 3.0, "gt")
    assert S.read_history(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "h.json").write_text('[{"run_id": "a", "recorded_at": "2024-01-15T10:00:00"}, {"run_id": "b", "recorded_at": "2024-01-16T10:00:00"}]')
    assert [x.run_id for x in S.read_history(spark, str(tmp_path / "h.json"), 1).collect()] == ["b"]


def test_history_days_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(days=1))], "run_id string, recorded_at timestamp_ntz")
    S.append_history(rows, str(tmp_path / "h"))
    S.append_history(rows.limit(1), str(tmp_path / "h"))
    back = spark.read.parquet(str(tmp_path / "h"))
    assert back.count() == 3 and back.filter("month = '2024-01-01'").count() == 3
    S.write_version(rows, str(tmp_path / "v"), 1)
    with pytest.raises(PySparkException):
        S.write_version(rows, str(tmp_path / "v"), 1)


def test_unreadable_stores_are_empty(spark, tmp_path):
    """A store that is not there, and files of one that are damaged."""
    schema = "entry_id long, pipeline string, at timestamp_ntz"
    assert S.read_table(spark, str(tmp_path / "none"), schema).count() == 0
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not a parquet file at all")
    assert S.last_entries(spark, str(bad), schema, ["at", "entry_id"]).count() == 0
    S.append(spark.createDataFrame([(1, "p", T0)], schema), str(bad))
    assert [r.entry_id for r in S.last_entries(spark, str(bad), schema, ["at", "entry_id"]).collect()] == [1]


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in S.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_deliveries(spark):
    out = S.deliveries(events(spark, event(1)), ["log", "x"])
    bad = one(S.failed_deliveries(out))
    assert (bad.channel, bad.error_message) == ("x", "Unsupported alert channel: 'x'")
    assert S.deliveries(events(spark, event(1)), []).count() == 1
