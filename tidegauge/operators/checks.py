"""Data-quality checks, rule evaluation and run reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.common import (
    SEVERITIES,
    broadcast_if_small,
    instant,
    micros,
    require,
    written,
)


def _number(value: float | None) -> Column:
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def row_count_checks(
    df: DataFrame,
    group: Sequence[str] = (),
    min_count: int | None = None,
    max_count: int | None = None,
    name: str = "row_count",
) -> DataFrame:
    """One check result per group: fail below ``min_count`` or above ``max_count`` (both inclusive)."""
    n = F.col("_n")
    low = n < F.lit(min_count) if min_count is not None else F.lit(False)
    high = n > F.lit(max_count) if max_count is not None else F.lit(False)
    # The wording of the messages.
    text = F.concat(F.lit("Row count "), n.cast("string"))
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).select(
        *group,
        F.lit(name).alias("check_name"),
        F.when(low | high, "fail").otherwise("pass").alias("status"),
        F.when(low, F.concat(text, F.lit(f" is below minimum {min_count}")))
        .when(high, F.concat(text, F.lit(f" exceeds maximum {max_count}")))
        .otherwise(F.concat(text, F.lit(" is within expected range")))
        .alias("message"),
        n.cast("double").alias("value"),
        F.when(low, _number(min_count)).when(high, _number(max_count)).alias("threshold"),
    )


def null_rate_checks(
    df: DataFrame,
    columns: Sequence[str],
    max_rate: float = 0.05,
    group: Sequence[str] = (),
    name: str = "null_rate",
) -> DataFrame:
    """One check result per group and column; every column is counted in the same pass."""
    require(len(columns) > 0, "columns must not be empty")
    counts = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{i}") for i, c in enumerate(columns)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_null_{i}").alias("nulls"))
            for i, c in enumerate(columns)
        ]
    )
    rows = counts.select(*group, "_n", F.explode(pairs).alias("_p")).select(
        *group, "_n", "_p.column", F.try_divide(F.col("_p.nulls"), F.col("_n")).alias("rate")
    )
    rate = F.col("rate")
    bad = rate > F.lit(max_rate)
    limit = f"{max_rate:.2%}"
    head = F.format_string("Null rate %.2f%% for '%s'", rate * 100, F.col("column"))
    return rows.select(
        *group,
        F.lit(name).alias("check_name"),
        "column",
        F.when(rate.isNull(), "error").when(bad, "fail").otherwise("pass").alias("status"),
        F.when(rate.isNull(), "Cannot compute null rate: total_count is zero")
        .when(bad, F.concat(head, F.lit(f" exceeds max {limit}")))
        .otherwise(F.concat(head, F.lit(" is acceptable")))
        .alias("message"),
        rate.alias("value"),
        F.when(rate.isNotNull(), F.lit(max_rate)).alias("threshold"),
    )


def freshness_checks(
    df: DataFrame,
    ts: str,
    as_of: str | Column,
    max_age_seconds: float,
    group: Sequence[str] = (),
    name: str = "freshness",
) -> DataFrame:
    """Age of the newest row per group against ``max_age_seconds`` (equal passes)."""
    newest = df.groupBy(*group).agg(F.max(ts).alias("_newest"))
    age = (micros(instant(as_of)) - micros("_newest")) / F.lit(1_000_000.0)
    bad = age > F.lit(float(max_age_seconds))
    shown = F.format_string("%.0f", age)
    return newest.select(
        *group,
        F.lit(name).alias("check_name"),
        F.when(age.isNull(), "error").when(bad, "fail").otherwise("pass").alias("status"),
        F.when(age.isNull(), "No rows to measure")
        .when(bad, F.concat(F.lit("Data is "), shown, F.lit(f"s old, exceeds max {max_age_seconds:.0f}s")))
        .otherwise(F.concat(F.lit("Data freshness OK ("), shown, F.lit("s old)")))
        .alias("message"),
        age.alias("value"),
        F.lit(float(max_age_seconds)).alias("threshold"),
    )


@dataclass(frozen=True)
class ValidationRule:
    """A rule on one field: required, min, max, type or regex."""

    field: str
    rule: str
    value: object = None
    message: str | None = None

    def __post_init__(self) -> None:
        require(
            self.rule in ("required", "min", "max", "type", "regex"),
            f"unknown validation rule {self.rule!r}",
        )


def validation_rules(rules: DataFrame) -> list[ValidationRule]:
    """Rules from a ``validation_rule`` table, in ``rule_idx`` order, to be written into one projection.

    For tables of many rules there is ``violations_by_table``, which joins them.
    """
    out = []
    for r in rules.orderBy("rule_idx").collect():
        value = float(r["value"]) if r["rule"] in ("min", "max") else r["value"]
        out.append(ValidationRule(r["field"], r["rule"], value, r["message"]))
    return out


# Type names that a rule may ask for, and the Spark types that satisfy them
# (a boolean is also an integer).
_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
_TYPE_CLASSES = {
    "int": _INT_TYPES,
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "str": (T.StringType,),
    "bool": (T.BooleanType,),
}
_VARIANT_PATTERNS = {
    "int": "^(TINYINT|SMALLINT|INT|BIGINT|BOOLEAN)",
    "float": "^(FLOAT|DOUBLE|DECIMAL)",
    "str": "^STRING",
    "bool": "^BOOLEAN",
}


def _violated(df: DataFrame, rule: ValidationRule, record: str | None) -> tuple[Column, Column]:
    """(predicate that is true on violation, the default message)."""
    # The wording of the messages below.
    name = rule.field
    if record is None:
        raw = F.col(name)
        text = raw.cast("string")
        dtype = df.schema[name].dataType
        # A text that is no number can't be compared, so it violates a limit.
        number = raw.try_cast("double") if isinstance(dtype, T.StringType) else raw
    else:
        raw = F.try_variant_get(F.col(record), f"$.{name}", "variant")
        text = F.try_variant_get(F.col(record), f"$.{name}", "string")
        number = F.try_variant_get(F.col(record), f"$.{name}", "double")
        raw = F.when(F.is_variant_null(raw), None).otherwise(raw)
        dtype = None
    if rule.rule == "required":
        return raw.isNull() | (text == ""), F.lit(f"Field '{name}' is required.")
    if rule.rule in ("min", "max"):
        word = ">=" if rule.rule == "min" else "<="
        bad = number < F.lit(rule.value) if rule.rule == "min" else number > F.lit(rule.value)
        if record is None and isinstance(dtype, T.StringType):
            bad = raw.isNotNull() & F.coalesce(bad, F.lit(True))
        head = F.lit(f"Field '{name}' must be {word} {rule.value}, got ")
        return bad, F.concat(head, text, F.lit("."))
    if rule.rule == "regex":
        bad = ~F.regexp_like(text, F.lit(f"^(?:{rule.value})\\z"))
        return bad, F.lit(f"Field '{name}' does not match pattern '{rule.value}'.")
    want = str(rule.value)
    if want not in _TYPE_CLASSES:
        return F.lit(False), F.lit(None).cast("string")
    if dtype is not None:
        ok = isinstance(dtype, _TYPE_CLASSES[want])
        got = F.lit(dtype.simpleString())
        return raw.isNotNull() & F.lit(not ok), F.concat(
            F.lit(f"Field '{name}' must be {want}, got "), got, F.lit(".")
        )
    kind = F.schema_of_variant(raw)
    return raw.isNotNull() & ~kind.rlike(_VARIANT_PATTERNS[want]), F.concat(
        F.lit(f"Field '{name}' must be {want}, got "), F.lower(kind), F.lit(".")
    )


def validate_records(
    df: DataFrame, rules: Sequence[ValidationRule], record: str | None = None
) -> DataFrame:
    """Add ``violations`` (array of field, rule, message) and ``passed`` to every row.

    ``record`` names a VARIANT column whose fields are validated; without it the
    fields are the columns of ``df``. It is one narrow projection.
    """
    require(len(rules) > 0, "rules must not be empty")
    found = []
    for r in rules:
        bad, text = _violated(df, r, record)
        text = F.lit(r.message) if r.message else text
        item = F.struct(
            F.lit(r.field).alias("field"), F.lit(r.rule).alias("rule"), text.alias("message")
        )
        found.append(F.when(F.coalesce(bad, F.lit(False)), item))
    violations = F.array_compact(F.array(*found))
    return df.withColumn("violations", violations).withColumn("passed", F.size("violations") == 0)


#: Bytes of a rule table that go into one expression.
RULE_BYTES = 4_000_000
_RULE = "rule string, value string, message string"


def _broken(rule: Column, name: str, raw: Column, text: Column, number: Column, numeric: bool, kind: Column, is_kind) -> Column:
    """The violation of one rule, a struct of a rule table, by a field; null if there is none.

    ``numeric``: a value that is no number is not compared; else it violates limits. ``is_kind``
    gives, for a type's name, whether the field is of it.
    """
    has, limit = raw.isNotNull(), rule["value"].try_cast("double")
    below, above = F.coalesce(number < limit, F.lit(not numeric)), F.coalesce(number > limit, F.lit(not numeric))
    field = F.lit(f"Field '{name}' ")
    bound = F.concat(limit.cast("string"), F.lit(", got "), text, F.lit("."))
    known = F.lit(False)
    for want in _TYPE_CLASSES:
        known = F.when(rule["value"] == want, ~is_kind(want)).otherwise(known)
    is_ = lambda k: rule["rule"] == k
    bad = (
        F.when(is_("required"), ~has | (F.coalesce(text, F.lit("")) == ""))
        .when(is_("min"), has & below).when(is_("max"), has & above)
        .when(is_("regex"), has & ~F.regexp_like(text, F.concat(F.lit("^(?:"), rule["value"], F.lit(")\\z"))))
        .otherwise(has & known)
    )
    # The wording of the messages.
    message = (
        F.when(is_("required"), F.concat(field, F.lit("is required.")))
        .when(is_("min"), F.concat(field, F.lit("must be >= "), bound))
        .when(is_("max"), F.concat(field, F.lit("must be <= "), bound))
        .when(is_("regex"), F.concat(field, F.lit("does not match pattern '"), rule["value"], F.lit("'.")))
        .otherwise(F.concat(field, F.lit("must be "), rule["value"], F.lit(", got "), kind, F.lit(".")))
    )
    found = F.struct(F.lit(name).alias("field"), rule["rule"].alias("rule"), F.coalesce(rule["message"], message).alias("message"))
    return F.when(F.coalesce(bad, F.lit(False)), found)


def _of_field(df: DataFrame, name: str, rules: Column, record: str | None) -> Column:
    """All violations of one field: its rules are an array, tried one after the other."""
    if record is not None:
        raw = F.try_variant_get(F.col(record), f"$.{name}", "variant")
        raw = F.when(F.is_variant_null(raw), None).otherwise(raw)
        text = F.try_variant_get(F.col(record), f"$.{name}", "string")
        kind = F.schema_of_variant(raw)
        number = F.coalesce(F.try_variant_get(F.col(record), f"$.{name}", "double"), text.try_cast("double"))
        values = raw, text, number, False, F.lower(kind), lambda want: F.coalesce(kind.rlike(_VARIANT_PATTERNS[want]), F.lit(False))
    elif name in df.columns:
        dtype, raw = df.schema[name].dataType, F.col(f"`{name}`")
        is_text = isinstance(dtype, T.StringType)
        number = raw.try_cast("double") if isinstance(dtype, (T.NumericType, T.StringType)) else F.lit(None).cast("double")
        text = raw.cast("string") if not isinstance(dtype, T.VariantType) else F.lit(None).cast("string")
        values = raw, text, number, not is_text, F.lit(dtype.simpleString()), lambda want: F.lit(isinstance(dtype, _TYPE_CLASSES[want]))
    else:
        null = F.lit(None).cast("string")
        values = null, null, F.lit(None).cast("double"), True, null, lambda want: F.lit(True)
    return F.array_compact(F.transform(rules, lambda r: _broken(r, name, *values)))


def violations_by_table(
    df: DataFrame, rules: DataFrame, id_columns: Sequence[str], record: str | None = None, most_bytes: int = RULE_BYTES
) -> DataFrame:
    """One row per violation, for a rule table of any size: the rules of each field are one constant array.

    A field that is not there reads as null. Rules of up to ``most_bytes`` are one projection
    over the rows; a larger table is taken in parts of that size, each of which is written
    before the next, so that no more is in the driver at once. No row is exchanged.
    """
    known = F.col("rule").isin("required", "min", "max", "type", "regex")
    slim = rules.select("field", F.struct("rule", F.col("value").cast("string").alias("value"), "message").alias("_rule"), "rule")
    sizes = slim.agg(
        F.coalesce(F.sum(F.octet_length(F.to_json("_rule")) + F.octet_length("field")), F.lit(0)), F.count_if(~F.coalesce(known, F.lit(False)))
    ).first()
    require(sizes[1] == 0, "unknown validation rule")
    parts = max(1, -(-sizes[0] // most_bytes))
    found = []
    for part in range(parts):
        own = slim.filter(F.pmod(F.xxhash64("field", "_rule"), F.lit(parts)) == part) if parts > 1 else slim
        by_field = own.groupBy("field").agg(F.to_json(F.collect_list("_rule")).alias("rules")).collect()
        arrays = [
            _of_field(df, r.field, F.from_json(F.lit(r.rules), f"array<struct<{_RULE}>>"), record)
            for r in sorted(by_field, key=lambda r: r.field)
        ]
        nothing = F.array().cast("array<struct<field:string,rule:string,message:string>>")
        violations = F.concat(*arrays) if arrays else nothing
        rows = df.select(*id_columns, F.explode(violations).alias("_v")).select(*id_columns, "_v.field", "_v.rule", "_v.message")
        found.append(written(rows, "violations") if parts > 1 else rows)
    return reduce(DataFrame.unionByName, found)


def violation_rows(validated: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """One row per violation."""
    return validated.select(*id_columns, F.explode("violations").alias("_v")).select(
        *id_columns, "_v.field", "_v.rule", "_v.message"
    )


def watermark_lag(
    pipelines: DataFrame, events: DataFrame, as_of: str | Column, threshold_seconds: float = 300.0
) -> DataFrame:
    """Lag of each pipeline's newest event time; a pipeline without events has lag 0."""
    marks = events.groupBy("pipeline").agg(F.max("triggered_at").alias("_mark"))
    now = instant(as_of)
    lag = F.greatest(
        F.lit(0.0),
        F.coalesce((micros(now) - micros("_mark")) / F.lit(1_000_000.0), F.lit(0.0)),
    )
    return pipelines.join(marks, "pipeline", "left").select(
        "pipeline",
        F.coalesce("_mark", now).alias("current_watermark"),
        lag.alias("lag_seconds"),
        (lag > F.lit(float(threshold_seconds))).alias("breached"),
    )


def dependency_block(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Every pipeline of the graph with its direct upstreams that failed; blocked when there is one."""
    bad = edges.join(
        failed.select(F.col("pipeline").alias("upstream")).distinct(), "upstream", "left_semi"
    )
    per = bad.distinct().groupBy("downstream").agg(
        F.sort_array(F.collect_list("upstream")).alias("_up")
    )
    nodes = edges.select(F.col("upstream").alias("pipeline")).union(edges.select("downstream")).distinct()
    return nodes.join(per, nodes.pipeline == per.downstream, "left").select(
        "pipeline",
        F.coalesce("_up", F.array().cast("array<string>")).alias("blocking"),
        F.col("_up").isNotNull().alias("blocked"),
    )


def schema_drift(catalog: DataFrame) -> DataFrame:
    """Columns added, removed or retyped between neighbouring batches of a column catalog.

    ``catalog`` has ``batch, column, type``; batch numbers may have gaps.
    """
    batches = catalog.select("batch").distinct()
    following = batches.select("batch", F.lead("batch").over(Window.orderBy("batch")).alias("_next"))
    old = catalog.join(following, "batch").filter(F.col("_next").isNotNull()).select(
        F.col("_next").alias("batch"), "column", F.col("type").alias("old_type")
    )
    first = catalog.agg(F.min("batch")).scalar()
    new = catalog.select("batch", "column", F.col("type").alias("new_type"))
    joined = old.join(new, ["batch", "column"], "full_outer")
    return (
        joined.filter(F.col("batch") > first)
        .filter(~F.col("old_type").eqNullSafe(F.col("new_type")))
        .select(
            "batch",
            "column",
            F.when(F.col("old_type").isNull(), "added")
            .when(F.col("new_type").isNull(), "removed")
            .otherwise("type_changed")
            .alias("change"),
            "old_type",
            "new_type",
        )
    )


def batch_catalog(df: DataFrame, batch: Column) -> DataFrame:
    """Column catalog of a table whose batches carry different columns.

    A column belongs to a batch when any of its rows has a value there.
    """
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    seen = df.groupBy(batch.alias("batch")).agg(
        *[F.count(F.col(n)).alias(f"_c{i}") for i, (n, _) in enumerate(fields)]
    )
    items = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.lit(t).alias("type"), F.col(f"_c{i}").alias("n"))
            for i, (n, t) in enumerate(fields)
        ]
    )
    return (
        seen.select("batch", F.explode(items).alias("_i"))
        .filter("_i.n > 0")
        .select("batch", "_i.column", "_i.type")
    )


def metric_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of threshold rules (gt, lt, gte, lte, eq) on metric values.

    A null ``pipeline`` in a rule means every pipeline.
    """
    m, r = metrics.alias("m"), broadcast_if_small(rules).alias("r")
    v, t, op = F.col("m.value"), F.col("r.threshold"), F.col("r.operator")
    fires = (
        F.when(op == "gt", v > t)
        .when(op == "lt", v < t)
        .when(op == "gte", v >= t)
        .when(op == "lte", v <= t)
        .when(op == "eq", v == t)
        .otherwise(False)
    )
    same = (F.col("m.metric") == F.col("r.metric")) & (
        F.col("r.pipeline").isNull() | (F.col("r.pipeline") == F.col("m.pipeline"))
    )
    return m.join(r, same & fires, "inner").select(
        F.col("m.pipeline").alias("pipeline"),
        F.col("m.metric").alias("metric"),
        F.col("r.name").alias("rule_name"),
        F.col("r.severity").alias("severity"),
        v.alias("value"),
        op.alias("operator"),
        t.alias("threshold"),
        F.col("m.recorded_at").alias("recorded_at"),
    )


def latest_results(results: DataFrame, order: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The last result per key by the given order."""
    rest = [c for c in results.columns if c not in keys]
    picked = results.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    )
    return picked.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def status_alerts(results: DataFrame, rules: DataFrame, order: Sequence[str]) -> DataFrame:
    """Alerts of status rules: the last result of the named check has a status in ``on_status``."""
    last = latest_results(results, order, ["check_name"])
    r = broadcast_if_small(
        rules.select("name", "check_name", "on_status", "severity", F.col("message").alias("_text"))
    )
    shown = F.concat(F.lit("["), F.upper("status"), F.lit("] "), F.col("check_name"), F.lit(": "), F.col("message"))
    text = F.when(F.length("_text") > 0, F.col("_text")).otherwise(shown)
    return (
        last.join(r, "check_name")
        .filter(F.array_contains("on_status", F.col("status")))
        .select(
            F.col("name").alias("rule_name"),
            "check_name",
            "severity",
            "status",
            text.alias("message"),
        )
    )


def run_report(results: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per run: totals, verdict and a summary line."""
    per = results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != "pass").alias("failed"),
    )
    fired = alerts.groupBy("run_id").agg(F.count(F.lit(1)).alias("_alerts"))
    n_alerts = F.coalesce("_alerts", F.lit(0))
    passed = F.col("failed") == 0
    line = F.format_string(
        "Run %s: %d/%d checks passed, %d alert(s) triggered",
        F.when(passed, "PASSED").otherwise("FAILED"),
        F.col("total") - F.col("failed"),
        F.col("total"),
        n_alerts,
    )
    return per.join(fired, "run_id", "left").select(
        "run_id", "total", "failed", n_alerts.alias("alerts"), passed.alias("passed"), line.alias("summary")
    )


def run_summary(alerts: DataFrame) -> DataFrame:
    """Display rows per run: one line per alert, then totals (``line_no`` null marks the totals).

    ``alerts`` needs run_id, line_no, check_name, passed, value, operator, threshold, severity.
    """
    metric = F.coalesce(F.col("value").cast("string"), F.lit("N/A"))
    limit = F.coalesce(
        F.concat_ws(" ", F.col("operator"), F.col("threshold").cast("string")), F.lit("N/A")
    )
    pad = lambda c, n: F.format_string(f"%-{n}s", c)
    line = F.concat_ws(
        " ",
        pad(F.col("check_name"), 30),
        pad(F.when(F.col("passed"), "PASS").otherwise("FAIL"), 8),
        pad(metric, 15),
        pad(limit, 15),
        F.col("severity"),
    )
    lines = alerts.select("run_id", "line_no", line.alias("line"))
    total, failed = F.count(F.lit(1)), F.count_if(~F.col("passed"))
    totals = alerts.groupBy("run_id").agg(
        F.format_string(
            "Total: %d  Passed: %d  Failed: %d  Overall result: %s",
            total,
            total - failed,
            failed,
            F.when(failed == 0, "PASSED").otherwise("FAILED"),
        ).alias("line")
    )
    return lines.unionByName(totals.select("run_id", F.lit(None).cast("bigint").alias("line_no"), "line"))


def baseline_drift(
    current: DataFrame, baseline: DataFrame, threshold_pct: float = 10.0
) -> DataFrame:
    """Change of each current value against its baseline; keys without a baseline give no row."""
    b = baseline.select("pipeline", "metric", F.col("value").alias("baseline_value"))
    delta = F.col("value") - F.col("baseline_value")
    pct = F.try_divide(delta, F.abs("baseline_value")) * 100
    return current.join(b, ["pipeline", "metric"]).select(
        "pipeline",
        "metric",
        "baseline_value",
        F.col("value").alias("current_value"),
        delta.alias("delta"),
        pct.alias("pct_change"),
        F.coalesce(F.abs(pct) > F.lit(float(threshold_pct)), F.lit(False)).alias("drifted"),
    )


def gate(verdicts: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row per gate: how many rows are bad, and whether the gate is closed."""
    require(len(verdicts) > 0, "no gates given")
    out = None
    for name, (df, bad) in verdicts.items():
        row = df.agg(
            F.count(F.lit(1)).alias("checked"), F.count_if(F.coalesce(bad, F.lit(False))).alias("bad")
        ).select(F.lit(name).alias("gate"), "checked", "bad", (F.col("bad") > 0).alias("closed"))
        out = row if out is None else out.unionByName(row)
    return out


def check_rules(rules: DataFrame) -> DataFrame:
    """Rule rows with defaults applied; a bad operator or severity fails the query."""
    sev = F.coalesce(F.col("severity"), F.lit("warning"))
    op_ok = F.col("operator").isin("gt", "lt", "gte", "lte", "eq")
    sev_ok = sev.isin(*SEVERITIES)
    return rules.select(
        *[c for c in rules.columns if c not in ("severity", "threshold", "operator")],
        F.when(op_ok, F.col("operator"))
        .otherwise(F.raise_error(F.concat(F.lit("invalid operator: "), F.coalesce(F.col("operator"), F.lit("null")))))
        .alias("operator"),
        F.col("threshold").cast("double").alias("threshold"),
        F.when(sev_ok, sev)
        .otherwise(F.raise_error(F.concat(F.lit("invalid severity: "), sev)))
        .alias("severity"),
    )
