"""Results that must not depend on table sizes, gaps, nulls or odd names."""

import fnmatch
import hashlib
import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidegauge.functions.common import ascii_json_text, glob_regex
from tidegauge.operators import aggregates as A
from tidegauge.operators import checks as C
from tidegauge.operators import enrich as E
from tidegauge.operators import filters as R
from tidegauge.operators import fold as K
from tidegauge.operators import graph as N
from tests.test_operators import column, event, events

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("number", [10, 3000])
def test_routes_keep_rows_at_any_rule_table_size(spark, number):
    df = events(
        spark, event(1, pipeline="p1"), event(1, pipeline="p2"), event(None, pipeline="p1"), event(None, pipeline=None))
    rules = [(0, "p1", None, None, "one"), (1, "p2", "info", [], "two"), (2, "", "info", None, "three")]
    rules += [(k, f"other{k}", None, None, "no") for k in range(3, number)]
    r = spark.createDataFrame(rules, "rule_idx int, pipeline string, severity string, tags array<string>, channel string")
    for limit in (0, 5, 100_000):
        got = [(x.event_id, x.pipeline, x.channels) for x in R.route(df, r, limit=limit).collect()]
        assert sorted(got, key=str) == sorted([
            (1, "p1", ["one", "three"]), (1, "p2", ["two", "three"]), (None, "p1", ["one", "three"]),
            (None, None, ["three"]),
        ], key=str)


GLOBS = ["*", "?", "a*b", "job[?]", "a[*]", "[!a]x", "[]a]", "[!]a]", "[a-c]1", "[c-a]1", "[!c-a]1", "[", "a[b", "[]", "x.y",
         "a\\b", "[\\]", "[&&a]", "[^a]", "[a-]", "(a|b)", "a+b$", "[[]", "{a}", "", "a-b", "é?", "[é-ü]"]
NAMES = ["", "a", "b", "ab", "axxb", "job?", "job.", "a*", "a.", "bx", "ax", "]", "]a", "a1", "b1", "c1", "d1", "[", "a[b", "[]",
         "x.y", "xzy", "a\\b", "\\", "&", "^", "-", "(a|b)", "a+b$", "{a}", "a\nb", "a-b", "éx", "ö"]


def test_globs_equal_shell_globs(spark):
    df = spark.createDataFrame([(g, n) for g in GLOBS for n in NAMES], "g string, n string")
    got = {(r.g, r.n): r.hit for r in df.withColumn("hit", F.regexp_like("n", glob_regex("g"))).collect()}
    assert got == {(g, n): fnmatch.fnmatchcase(n, g) for g in GLOBS for n in NAMES}


@pytest.mark.parametrize("few", [0, 1_000])
def test_silence_by_equality_and_by_glob(spark, monkeypatch, few):
    monkeypatch.setattr(R, "SILENCE_BLOCK", 2)
    names = ["p1", "p2", "q?", "a.b"]
    df = events(spark, *[event(10 * i + j, pipeline=p, check=c) for i, p in enumerate(names) for j, c in enumerate(names)])
    rules = [("p1", "p2"), ("p?", "a.b"), ("a.b", "*"), ("q[?]", "p[!1]"), ("[a]*", "[q]?"), ("zz*", "y?"), ("*z", "?")]
    r = spark.createDataFrame([(a, b, None) for a, b in rules], "pipeline_glob string, check_glob string, expires_at timestamp_ntz")
    want = {10 * i + j for i, p in enumerate(names) for j, c in enumerate(names)
            if not any(fnmatch.fnmatchcase(p, a) and fnmatch.fnmatchcase(c, b) for a, b in rules)}
    assert {x.event_id for x in R.silence(df, r, "2024-01-01 00:00:00", few).collect()} == want


def test_silence_with_every_pair_of_globs(spark):
    """All odd globs on both sides, filed by their pieces, against trying each."""
    df = events(spark, *[event(100 * i + j, pipeline=p, check=c) for i, p in enumerate(NAMES) for j, c in enumerate(NAMES)])
    schema = "pipeline_glob string, check_glob string, expires_at timestamp_ntz"
    for some in (GLOBS[1::3], GLOBS[2::3], ["*x?", "a*", "job?", "*b*", "?", "a.*y"]):
        rules = [(a, b, None) for a in some for b in some]
        r = spark.createDataFrame(rules, schema)
        want = {100 * i + j for i, p in enumerate(NAMES) for j, c in enumerate(NAMES)
                if any(fnmatch.fnmatchcase(p, a) for a in some) and any(fnmatch.fnmatchcase(c, b) for b in some)}
        left = {x.event_id for x in R.silence(df, r, "2024-01-01 00:00:00", few=0).collect()}
        assert {100 * i + j for i in range(len(NAMES)) for j in range(len(NAMES))} - left == want


def test_many_globs_on_many_keys(spark):
    """Tens of thousands of globs and keys meet by equality of pieces; no loop over all pairs in the plan."""
    keys = spark.range(20_000).select(
        F.col("id").alias("event_id"), F.concat(F.lit("team"), F.col("id") % 500, F.lit("-job"), F.col("id")).alias("pipeline"),
        F.concat(F.lit("check"), F.col("id") % 50).alias("check_name"))
    rules = spark.range(20_000).select(
        F.concat(F.lit("team"), F.col("id") % 500, F.lit("-job"), F.col("id") * 2, F.lit("*")).alias("pipeline_glob"),
        F.lit("check*").alias("check_glob"), F.lit(None).cast("timestamp_ntz").alias("expires_at"))
    left = R.silence(keys, rules, "2024-01-01 00:00:00")
    names = {f"team{i % 500}-job{i}" for i in range(20_000)}
    globs = {f"team{i % 500}-job{2 * i}" for i in range(20_000)}
    gone = {n for n in names if any(n[:k] in globs for k in range(1, len(n) + 1))}
    assert left.count() == 20_000 - len(gone)


def test_fingerprint_of_any_name(spark):
    names = ["plain", "é", "日本", "\U0001f600", 'q"\\/', "\b\f\n\r\t\x01\x1f\x7f", "", " x "]
    df = spark.createDataFrame([(n, "c", "info") for n in names], "pipeline string, check_name string, severity string")
    got = df.select("pipeline", ascii_json_text("pipeline").alias("j"), E.fingerprint().alias("f")).collect()
    for r in got:
        assert r.j == json.dumps(r.pipeline)
        text = json.dumps({"pipeline": r.pipeline, "check": "c", "severity": "info"}, sort_keys=True)
        assert r.f == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("expression", ["* * * *", "0,30 * * * *", "x * * * *", "* * * * mon", "* * 1-2-3 * *", ""])
def test_malformed_schedules_are_errors(spark, expression):
    s = spark.createDataFrame([("ok", "p", "@daily"), ("bad", "p", expression)], "name string, pipeline string, expression string")
    with pytest.raises(PySparkException, match="schedule"):
        R.due_minutes(s, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()


def test_missed_runs_with_bounds(spark):
    s = spark.createDataFrame([("h", "p", "@hourly"), ("q", "q", "@daily")], "name string, pipeline string, expression string")
    due = R.due_minutes(s, "2024-01-01 00:00:00", "2024-01-01 06:00:00")
    runs = events(spark, event(1, 0), event(2, 60.5), event(3, 360.9), event(4, 0, pipeline="other"), event(5, 9999))
    plain = R.missed_runs(due, runs).select("name", "due_at")
    bound = R.missed_runs(due, runs, "2024-01-01 00:00:00", "2024-01-01 06:00:00").select("name", "due_at")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, bound.collect()))
    assert plain.count() == 5


def test_schema_drift_over_a_gap(spark):
    c = spark.createDataFrame(
        [(1, "a", "int"), (1, "b", "int"), (2, "a", "int"), (4, "a", "bigint"), (4, "c", "int")], "batch int, column string, type string")
    got = {(r.batch, r.column, r.change) for r in C.schema_drift(c).collect()}
    assert got == {(2, "b", "removed"), (4, "a", "type_changed"), (4, "c", "added")}


def test_normalize_keeps_null(spark):
    m = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("a", 5.0)], "metric string, value double")
    r = spark.createDataFrame(
        [(1, "a", "minmax", 0.0, 10.0, None, None), (2, "b", "clamp", None, None, 1.0, 2.0), (3, "c", "zscore", None, None, None, None)],
        "rule_idx int, metric string, strategy string, min_val double, max_val double, clamp_low double, clamp_high double")
    assert sorted((x.metric, x.normalized) for x in E.normalize(m, r).collect() if x.normalized is not None) == [("a", 0.5)]
    assert E.normalize(m, r).filter("normalized is null").count() == 3


RECORDS = [(1, "12", "x"), (2, "abc", ""), (3, None, None), (4, "99", "yy")]


def test_limits_on_texts_and_rules_by_table(spark):
    df = spark.createDataFrame(RECORDS, "id int, t string, u string")
    rules = [C.ValidationRule("t", "min", 20.0), C.ValidationRule("t", "max", 50.0), C.ValidationRule("u", "required"),
             C.ValidationRule("u", "regex", "x|y+", "odd")]
    plain = C.violation_rows(C.validate_records(df, rules), ["id"])
    table = spark.createDataFrame(
        [(r.field, r.rule, None if r.value is None else str(r.value), r.message) for r in rules],
        "field string, rule string, value string, message string")
    by_table = C.violations_by_table(df, table, ["id"])
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, by_table.collect())) == want
    assert {(r.id, r.field, r.rule) for r in plain.collect()} == {
        (1, "t", "min"), (2, "t", "min"), (2, "t", "max"), (2, "u", "required"), (2, "u", "regex"), (3, "u", "required"), (4, "t", "max")}


def test_many_rules_by_table(spark):
    df = spark.range(50).select(F.col("id"), F.col("id").cast("string").alias("t"))
    rules = spark.range(5000).select(
        F.lit("t").alias("field"), F.lit("max").alias("rule"), F.col("id").cast("string").alias("value"), F.lit("m").alias("message"))
    assert C.violations_by_table(df, rules, ["id"]).count() == sum(range(50))
    # A table of more bytes than go into one expression is taken in parts.
    assert C.violations_by_table(df, rules, ["id"], most_bytes=100_000).count() == sum(range(50))


RULE_TABLE = "rule_idx int, field string, rule string, value string, message string"


@pytest.mark.parametrize("most_bytes", [16_000_000, 300])
def test_every_kind_of_rule_from_a_table(spark, most_bytes):
    """Columns and VARIANT records, fields that are not there, texts that are no numbers, own messages."""
    rules = [
        (1, "n", "required", None, None), (2, "n", "min", "2", None), (3, "n", "max", "3.5", None), (4, "n", "type", "str", None),
        (5, "t", "required", None, "no text"), (6, "t", "regex", "a|b.*", None), (7, "t", "type", "int", None),
        (8, "gone", "required", None, None), (9, "gone", "min", "1", None), (10, "t", "type", "date", None),
        (11, "n", "type", "int", None), (12, "t", "min", "5", None), (13, "gone", "regex", "x", None), (14, "n", "max", "3", "large"),
    ]
    table = spark.createDataFrame(rules, RULE_TABLE)
    rows = [(1, 1, "a"), (2, 3, "bcd"), (3, None, ""), (4, 4, None), (5, 2, "7")]
    df = spark.createDataFrame(rows, "id int, n int, t string")
    name = lambda v: {int: "int", str: "string"}[type(v)]

    def number(v):
        try:
            return float(v)
        except ValueError:
            return None

    def brute(record, names):
        out = []
        for _, f, kind, value, message in rules:
            v, bad, text = record.get(f), False, None
            if kind == "required":
                bad, text = v is None or v == "", f"Field '{f}' is required."
            elif v is not None and kind in ("min", "max"):
                x, limit = number(v), float(value)
                bad = x is None or (x < limit if kind == "min" else x > limit)
                text = f"Field '{f}' must be {'>=' if kind == 'min' else '<='} {limit}, got {v}."
            elif v is not None and kind == "regex":
                bad, text = re.fullmatch(value, str(v)) is None, f"Field '{f}' does not match pattern '{value}'."
            elif v is not None and kind == "type" and value in ("int", "str"):
                bad, text = not isinstance(v, {"int": int, "str": str}[value]), f"Field '{f}' must be {value}, got {names(v)}."
            if bad:
                out.append((f, kind, message or text))
        return out

    want = sorted((i, *x) for i, n, t in rows for x in brute({"n": n, "t": t}, name))
    got = C.violations_by_table(df, table, ["id"], most_bytes=most_bytes)
    assert sorted(tuple(r) for r in got.collect()) == want
    records = df.select("id", F.try_parse_json(F.to_json(F.struct("n", "t"))).alias("r"))
    variant = lambda v: {int: "bigint", str: "string"}[type(v)]
    want = sorted((i, *x) for i, n, t in rows for x in brute({"n": n, "t": t}, variant))
    got = C.violations_by_table(records, table, ["id"], record="r", most_bytes=most_bytes)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_unknown_rules_in_a_table_are_errors(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    bad = spark.createDataFrame([(1, "t", "nope", None, None)], RULE_TABLE)
    with pytest.raises(ValueError):
        C.violations_by_table(df, bad, ["id"])
    assert C.violations_by_table(df, bad.limit(0), ["id"]).count() == 0


def runs(spark, rows):
    return spark.createDataFrame(
        [(i, p, "c", ok, T0 + timedelta(minutes=m)) for i, p, ok, m in rows],
        "run_id bigint, pipeline string, check_name string, passed boolean, recorded_at timestamp_ntz")


def test_compaction_keeps_what_is_not_known_to_have_passed(spark):
    h = runs(spark, [(1, "p", True, 0), (2, "p", True, 0.1), (3, "p", None, 0.2), (4, "p", False, 0.3)])
    got = K.compact(h, window_seconds=600, max_entries=10)
    assert {r.run_id for r in got.collect()} == {1, 3, 4}


def test_null_keys_stay(spark):
    h = runs(spark, [(1, None, True, 0), (2, None, False, 1), (3, "p", True, 2)])
    got = A.digest(h, "2024-01-01 01:00:00", 24).collect()
    assert sorted((r.pipeline or "", r.total_runs, r.consecutive_failures) for r in got) == [("", 2, 1), ("p", 1, 0)]
    s = spark.createDataFrame(
        [(i, None if i % 2 else "p", "c", float(i)) for i in range(40)], "sample_id bigint, pipeline string, check_name string, duration_ms double")
    for exact_rows in (100, 5):
        got = A.profile_report(s, exact_rows=exact_rows).collect()
        assert sorted((r.pipeline or "", r["count"], r.p95_ms) for r in got) == [("", 20, 37.0), ("p", 20, 36.0)]


@pytest.mark.parametrize("closed", [False, True])
def test_cycles_behind_chains(spark, closed):
    n = 300
    edges = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [("n5", "side"), ("side", "n9"), ("end", "n0")]
    edges += [(f"n{n}", "n7")] if closed else []
    df = spark.createDataFrame(edges, "upstream string, downstream string")
    assert N.has_cycle(df).first()[0] is closed


def test_small_cycles(spark):
    schema = "upstream string, downstream string"
    for edges, want in (([], False), ([("a", "a")], True), ([("a", "b"), ("b", "a")], True), ([("a", "b"), ("b", "c"), ("a", "c")], False)):
        assert N.has_cycle(spark.createDataFrame(edges, schema)).first()[0] is want


def test_events_without_a_time_are_set_aside(spark):
    df = events(spark, event(1, 0), event(2, 1), event(4, 50)).unionByName(
        events(spark, event(3, 0), event(5, 0, pipeline="q")).withColumn("triggered_at", F.lit(None).cast("timestamp_ntz")))
    for max_rows in (None, 2):
        got = {r.event_id: r.fired for r in K.dedupe(df, 30, max_rows=max_rows).collect()}
        assert got == {1: True, 2: False, 4: True, 3: None, 5: None}
        got = {r.event_id: r.batch_no for r in K.batch(df, 2, 10_000, max_rows=max_rows).collect()}
        assert got == {1: 0, 2: 0, 4: 1, 3: None, 5: None}


def test_joins_per_key_do_not_shuffle_events_for_few_keys(spark):
    df = events(spark, event(1), event(2, pipeline=None))
    plan = R.backlog_depth(df, F.col("pipeline"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    got = {r.event_id: r.queue_depth for r in R.backlog_depth(df, F.col("pipeline")).collect()}
    assert got == {1: 1, 2: 1}


@pytest.mark.parametrize("suppressed", [False, True])
def test_maintenance_by_time_slots(spark, suppressed):
    """Windows of seconds to decades, open at neither end, against trying each; nulls match nothing."""
    import random

    rng = random.Random(3)
    at = lambda s: T0 + timedelta(seconds=s)
    windows = [("p1", at(0), at(0)), ("p1", at(10), at(5)), ("p2", None, at(9)), ("p2", at(0), None), (None, at(0), at(10**6))]
    for _ in range(300):
        start = rng.uniform(-10**7, 10**7)
        windows.append((rng.choice(["p1", "p1", "p1", "p2"]), at(start), at(start + 10 ** rng.uniform(-2, 5.5))))
    windows += [("p3", at(-3 * 10**8), at(-2 * 10**8)), ("p3", at(5 * 10**6), datetime(9999, 12, 31))]
    w = spark.createDataFrame(windows, "pipeline string, start_at timestamp_ntz, end_at timestamp_ntz")
    rows = [(i, rng.choice(["p1", "p2", "p3", "p4"]), at(rng.uniform(-10**7, 10**7))) for i in range(600)]
    rows += [(600, "p1", at(0)), (601, None, at(1)), (602, "p1", None), (603, "p1", windows[9][1]), (604, windows[9][0], windows[9][2])]
    e = spark.createDataFrame(rows, "event_id int, pipeline string, triggered_at timestamp_ntz")
    want = {i for i, p, t in rows if suppressed == any(
        p is not None and p == q and None not in (t, a, b) and a <= t <= b for q, a, b in windows)}
    for limit in (0, 20_000):
        assert {r.event_id for r in R.in_maintenance(e, w, suppressed, limit).collect()} == want


def test_a_pipeline_of_many_events_and_windows_is_spread(spark):
    """One pipeline has half of the events and half of 40,000 windows: they meet by time."""
    events_ = spark.range(40_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 100)).alias("pipeline"),
        F.timestamp_seconds(F.col("id") * 900).cast("timestamp_ntz").alias("triggered_at"))
    windows = events_.select("pipeline", F.col("triggered_at").alias("start_at"), F.expr("triggered_at + interval 10 seconds").alias("end_at"))
    left = R.in_maintenance(events_, windows)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "_slot" in plan and left.count() == 0


@pytest.mark.parametrize("few", [0, 200_000])
def test_cycles_in_one_task_and_in_rounds(spark, monkeypatch, few):
    """Random graphs, self-loops, chains, repeated edges and nulls: what is left after peeling is the same."""
    import random

    monkeypatch.setattr(N, "FEW_EDGES", few)
    rng = random.Random(4)
    graphs = [[(str(rng.randint(0, n)), str(rng.randint(0, n))) for _ in range(m)] for n, m in ((4, 3), (12, 9), (30, 36))]
    graphs += [[(str(i), str(i + 1)) for i in range(40)], [("a", "a"), ("a", "b")], [("a", "b"), ("b", None), (None, "a")],
               [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("z", "a"), ("a", "b")]]
    for edges in graphs:
        left = {e for e in edges if None not in e}
        while True:
            starts, ends = {a for a, _ in left}, {b for _, b in left}
            now = {(a, b) for a, b in left if a in ends and b in starts}
            if now == left:
                break
            left = now
        df = spark.createDataFrame(edges, "upstream string, downstream string")
        assert {(r.upstream, r.downstream) for r in N.cyclic_edges(df).collect()} == left
        assert N.has_cycle(df).first().has_cycle == bool(left)


def test_a_long_chain_is_taken_in_one_task(spark):
    df = spark.range(10_000).select(F.col("id").cast("string").alias("upstream"), (F.col("id") + 1).cast("string").alias("downstream"))
    assert not N.has_cycle(df).first().has_cycle
    assert N.has_cycle(df.union(spark.createDataFrame([("10000", "0")], df.schema))).first().has_cycle


@pytest.mark.parametrize("page", [1, 2, 3, 7, 40, 67, 68, 5000])
def test_deep_pages_are_those_of_a_whole_sort(spark, page):
    """Nulls, ties in the first column, a page over partitions, the last part of a page, and none."""
    from tidegauge.operators import limits as L

    df = spark.range(1_000).select(F.when(F.col("id") % 11 > 0, F.col("id") * 37 % 50).alias("a"), "id").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = [tuple(r) for r in L.page(df, ["a", "id"], page, 15, deep_rows=0).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = sorted(((r.a, r.id) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == every[(page - 1) * 15 : page * 15]
