"""Filters, routing, sampling, retention and calendars."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.common import (
    BROADCAST_ROWS,
    col,
    glob_regex,
    is_literal_glob,
    hash_uniform,
    instant,
    micros,
    plus_seconds,
    require,
    salted_join,
    within_rows,
    written,
)


# Silence rules that are tried together on every key.
SILENCE_BLOCK = 1_000
# Letters of a glob's prefix or suffix that it is filed under.
PIECE = 24
# Time slots of windows: an hour, 64 hours, and so on.
SLOT_US, SLOT_FAN, SLOT_LEVELS = 3_600_000_000, 64, 6
# Bytes of rules that are broadcast at most.
RULE_BYTES = 16_000_000


def filter_chain(df: DataFrame, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """Add ``kept``: all include predicates hold and no exclude predicate does.

    ``rules`` are (name, predicate, "include" | "exclude"); a null predicate is false.
    """
    kept = F.lit(True)
    for _, predicate, mode in rules:
        require(mode in ("include", "exclude"), f"unknown mode {mode!r}")
        hit = F.coalesce(predicate, F.lit(False))
        kept = kept & (hit if mode == "include" else ~hit)
    return df.withColumn("kept", kept)


def acceptance(flagged: DataFrame, flag: str = "kept") -> DataFrame:
    """Accepted and rejected counts and the acceptance rate (1.0 for no rows)."""
    return flagged.agg(
        F.count_if(F.col(flag)).alias("accepted"),
        F.count_if(~F.col(flag)).alias("rejected"),
        F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(1.0)).alias("rate"),
    )


def split(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """The rows where the predicate holds, and all the others."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.filter(hit), df.filter(~hit)


def tag_match(tags: str | Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclude wins; an empty include list accepts everything else."""
    t = F.coalesce(col(tags), F.array().cast("array<string>"))
    ok = F.lit(True)
    if include:
        ok = F.arrays_overlap(t, F.array(*[F.lit(x) for x in include]))
    if exclude:
        ok = ok & ~F.arrays_overlap(t, F.array(*[F.lit(x) for x in exclude]))
    return F.coalesce(ok, F.lit(False))


def tag_filter(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.filter(tag_match("tags", include, exclude))


def common_tags(tags: str | Column, wanted: Sequence[str]) -> Column:
    """Tags that are also in ``wanted``."""
    t = F.coalesce(col(tags), F.array().cast("array<string>"))
    return F.array_intersect(t, F.array(*[F.lit(x) for x in wanted]).cast("array<string>"))


def active_silences(rules: DataFrame, now: str | Column) -> DataFrame:
    """Silence rules that have not expired (no expiry never expires)."""
    return rules.filter(F.col("expires_at").isNull() | (instant(now) < F.col("expires_at")))


def _pieces(glob: Column) -> Column:
    """The literal pieces of a glob, between its wildcards; the first and last are its prefix and suffix."""
    return F.split(F.regexp_replace(glob, r"(?s)\[!?+\]?+[^\]]*+\]|[*?]", "\u0000"), "\u0000")


def _terms(name: str, glob: str) -> list[Column]:
    """What a glob may be filed under: (kind, text) of its prefix, its suffix and a trigram of its longest piece."""
    pieces = _pieces(F.col(glob))
    longest = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    ends = [(pieces[0], F.substring(pieces[0], 1, PIECE)), (F.element_at(pieces, -1), F.right(F.element_at(pieces, -1), F.lit(PIECE)))]
    out = [
        F.struct(F.length(cut).alias("n"), F.lit(f"{name}{kind}").alias("kind"), cut.alias("term"))
        for kind, (whole, cut) in zip("ps", ends)
    ]
    gram = F.when(F.length(longest) >= 3, F.substring(longest, 1, 3))
    return [*out, F.struct(F.coalesce(F.length(gram), F.lit(0)).alias("n"), F.lit(f"{name}g").alias("kind"), gram.alias("term"))]


def _probes(name: str, column: str, sizes: dict[str, list[int]]) -> Column:
    """What a name is looked up by: its prefixes and suffixes of the lengths that are filed, and its trigrams."""
    text, kinds = F.col(column), []
    for kind, cut in (("p", lambda n: F.substring(text, 1, n)), ("s", lambda n: F.right(text, F.lit(n)))):
        for n in sizes.get(f"{name}{kind}", []):
            kinds.append(F.when(F.length(text) >= n, F.struct(F.lit(f"{name}{kind}").alias("kind"), cut(n).alias("term"))))
    out = F.array_compact(F.array(*kinds)) if kinds else F.array().cast("array<struct<kind:string,term:string>>")
    if f"{name}g" in sizes:
        at = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
        grams = F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))
        out = F.concat(out, F.transform(grams, lambda g: F.struct(F.lit(f"{name}g").alias("kind"), g.alias("term"))))
    return out


def _indexed_hits(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys that match a rule of two globs, by an index of the globs' literal pieces.

    A rule is filed under the longest of its prefixes, suffixes and trigrams, so that keys
    meet by equality only the rules that have it in common with them. Rules of two globs
    without any letter of their own are tried in blocks.
    """
    terms = F.array(*_terms("p", "_gp"), *_terms("c", "_gc"))
    filed = rules.withColumn("_term", F.array_max(F.filter(terms, lambda x: x["n"] > 0))).select(
        "*", F.col("_term.kind").alias("_kind"), F.col("_term.term").alias("_text"))
    filed = written(filed.drop("_term"), "globs")
    sizes: dict[str, list[int]] = {}
    # At most ``PIECE`` lengths of four kinds, and two kinds of trigrams.
    for kind, n in filed.where("_kind is not null").select("_kind", F.length("_text")).distinct().collect():
        sizes.setdefault(kind, []).append(n)
    like = F.regexp_like(F.col("pipeline"), F.col("_p")) & F.regexp_like(F.col("check_name"), F.col("_c"))
    probes = F.concat(_probes("p", "pipeline", sizes), _probes("c", "check_name", sizes))
    asked = keys.select("pipeline", "check_name", F.explode(probes).alias("_x"))
    by_term = (F.col("_x.kind") == F.col("_kind")) & (F.col("_x.term") == F.col("_text"))
    hits = asked.join(filed, by_term & like, "left_semi").drop("_x")
    bare = filed.where("_kind is null")
    blocks = -(-bare.count() // SILENCE_BLOCK)
    if not blocks:
        return hits
    dealt = bare.withColumn("_block", F.pmod(F.xxhash64("_p", "_c"), F.lit(blocks)).cast("int"))
    spread = keys.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # With one block the key is constant; its rules are few, so they are broadcast.
    dealt = F.broadcast(dealt) if blocks == 1 else dealt
    return hits.unionByName(spread.join(dealt, (F.col("_at") == F.col("_block")) & like, "left_semi").drop("_at"))


def silence(events: DataFrame, rules: DataFrame, now: str | Column, few: int = SILENCE_BLOCK) -> DataFrame:
    """Drop events whose pipeline and check match an active silence rule.

    Rules are tried once per distinct (pipeline, check), not once per event. Up to ``few``
    are tried as they are; of more, literal names are met by equality and globs by an index.
    """
    r = active_silences(rules, now)
    r = r.select(
        F.col("pipeline_glob").alias("_gp"), F.col("check_glob").alias("_gc"),
        is_literal_glob("pipeline_glob").alias("_lp"), is_literal_glob("check_glob").alias("_lc"),
        glob_regex("pipeline_glob").alias("_p"), glob_regex("check_glob").alias("_c"),
    ).distinct()
    keys = events.select("pipeline", "check_name").distinct()
    like_p = F.regexp_like(F.col("pipeline"), F.col("_p"))
    like_c = F.regexp_like(F.col("check_name"), F.col("_c"))
    if within_rows(r, few):
        hit = keys.join(F.broadcast(r), like_p & like_c, "left_semi")
    else:
        by_p, by_c = F.col("pipeline") == F.col("_gp"), F.col("check_name") == F.col("_gc")
        r, keys = written(r, "silences"), written(keys, "silence-keys")
        hit = (
            keys.join(r.filter("_lp and _lc"), by_p & by_c, "left_semi")
            .unionByName(keys.join(r.filter("_lp and not _lc"), by_p & like_c, "left_semi"))
            .unionByName(keys.join(r.filter("not _lp and _lc"), by_c & like_p, "left_semi"))
            .unionByName(_indexed_hits(keys, r.filter("not _lp and not _lc")))
            .distinct()
        )
    return salted_join(events, hit, ["pipeline", "check_name"], salt="event_id", how="left_anti")


def _slot(at: Column, level: int) -> Column:
    return F.floor(micros(at) / F.lit(SLOT_US * SLOT_FAN**level)).cast("bigint")


def _slotted(windows: DataFrame) -> DataFrame:
    """Windows by the time slots that they touch, ``SLOT_FAN`` + 1 at most, on the finest level on which it is so few."""
    span = micros("end_at") - micros("start_at")
    level = F.lit(SLOT_LEVELS - 1)
    for n in range(SLOT_LEVELS - 2, -1, -1):
        level = F.when(span < F.lit(SLOT_US * SLOT_FAN ** (n + 1)), n).otherwise(level)
    found = windows.filter(F.col("end_at") >= F.col("start_at")).withColumn("_level", level)
    slots = F.sequence(_slot(F.col("start_at"), 0), _slot(F.col("end_at"), 0))
    for n in range(1, SLOT_LEVELS):
        slots = F.when(F.col("_level") == n, F.sequence(_slot(F.col("start_at"), n), _slot(F.col("end_at"), n))).otherwise(slots)
    return found.withColumn("_slot", F.explode(slots))


def in_maintenance(
    events: DataFrame, windows: DataFrame, suppressed: bool = False, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Events outside every maintenance window of their pipeline (or inside one, if ``suppressed``).

    Up to ``limit`` windows are broadcast. More are cut into time slots of several widths,
    and events meet those of their pipeline and slot, so that neither a pipeline with very
    many events nor one with very many windows is in one task.
    """
    w = windows.select(F.col("pipeline").alias("_p"), "start_at", "end_at")
    here = F.col("triggered_at").between(F.col("start_at"), F.col("end_at"))
    how = "left_semi" if suppressed else "left_anti"
    if within_rows(w, limit):
        return events.join(F.broadcast(w), (F.col("pipeline") == F.col("_p")) & here, how)
    w = written(_slotted(w), "window-slots")
    inside, rest = [], events
    # As many joins as there are widths in use.
    for level in sorted(r[0] for r in w.select("_level").distinct().collect()):
        own = w.filter(F.col("_level") == level)
        same = (F.col("pipeline") == F.col("_p")) & (_slot(F.col("triggered_at"), level) == F.col("_slot")) & here
        inside.append(rest.join(own, same, "left_semi"))
        rest = rest.join(own, same, "left_anti")
    return reduce(DataFrame.unionByName, inside, events.limit(0)) if suppressed else rest


def window_status(windows: DataFrame, now: str | Column) -> DataFrame:
    """Maintenance windows with ``active`` and ``expired`` flags."""
    n = instant(now)
    return windows.withColumn("active", n.between(F.col("start_at"), F.col("end_at"))).withColumn(
        "expired", F.col("end_at") < n
    )


def match_rules(events: DataFrame, rules: DataFrame, payload: Sequence[str], limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``matched``: the rules that fit each event, as structs in ``rule_idx`` order.

    A null or empty rule ``pipeline``/``severity``/``tags`` matches anything. Rules are
    listed by what they ask for, and each event looks up four lists: those for its
    pipeline and severity, for one of them, and for neither. Up to ``limit`` rules of
    ``RULE_BYTES`` are broadcast; lists of more meet events that are spread by a salt.
    Rows stay as they are either way.
    """
    any_tags = F.array().cast("array<string>")
    tags = F.coalesce(F.col("tags"), any_tags) if "tags" in rules.columns else any_tags
    r = rules.select(
        F.when(F.col("pipeline") != "", F.col("pipeline")).alias("_p"),
        F.when(F.col("severity") != "", F.col("severity")).alias("_s"),
        F.struct("rule_idx", *payload, tags.alias("_t")).alias("_rule"),
    )
    sizes = r.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json("_rule"))), F.lit(0))).first()
    few = sizes[0] <= limit and sizes[1] <= RULE_BYTES
    event_tags = F.coalesce(F.col("tags"), any_tags)
    out, names = events, []
    for keys in ({"_p": "pipeline", "_s": "severity"}, {"_p": "pipeline"}, {"_s": "severity"}):
        wanted = F.lit(True)
        for k in ("_p", "_s"):
            wanted = wanted & (F.col(k).isNotNull() if k in keys else F.col(k).isNull())
        name = "_rules" + "".join(keys)
        lists = r.filter(wanted).groupBy(*keys).agg(F.collect_list("_rule").alias(name))
        if few:
            same = F.lit(True)
            for k, c in keys.items():
                same = same & (F.col(c) == F.col(k))
            out = out.join(F.broadcast(lists), same, "left").drop(*keys)
        else:
            lists = lists.select(*[F.col(k).alias(c) for k, c in keys.items()], name)
            out = salted_join(out, lists, list(keys.values()), salt="event_id")
        names.append(name)
    out = out.withColumn(
        "_rules", r.filter(F.col("_p").isNull() & F.col("_s").isNull()).agg(F.collect_list("_rule")).scalar()
    )
    none = F.array().cast(out.schema["_rules"].dataType)
    found = F.concat("_rules", *[F.coalesce(F.col(n), none) for n in names])
    fits = F.filter(found, lambda x: (F.size(x["_t"]) == 0) | F.arrays_overlap(x["_t"], event_tags))
    slim = F.transform(fits, lambda x: F.struct(*[x[c].alias(c) for c in ("rule_idx", *payload)]))
    return out.withColumn("matched", F.array_sort(slim)).drop("_rules", *names)


def route(events: DataFrame, rules: DataFrame, default: str = "default", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``channels``: one per matching rule, in rule order; the default when none matches."""
    m = match_rules(events, rules, ["channel"], limit=limit)
    names = F.transform("matched", lambda x: x["channel"])
    return m.withColumn(
        "channels", F.when(F.size("matched") > 0, names).otherwise(F.array(F.lit(default)))
    ).drop("matched")


def shed_priority(severity: str | Column) -> Column:
    s = col(severity)
    return F.when(s == "critical", 10).when(s == "warning", 5).when(s == "info", 1).otherwise(0)


def shed(
    events: DataFrame,
    max_queue_depth: int = 100,
    min_priority: int = 0,
    depth: str | Column = "queue_depth",
    shed_on_overload: bool = True,
) -> DataFrame:
    """Add ``shed``: the queue is overloaded and the event's priority is below the minimum."""
    require(max_queue_depth >= 1, "max_queue_depth must be >= 1")
    require(min_priority >= 0, "min_priority must be >= 0")
    over = F.lit(shed_on_overload) & (col(depth) >= F.lit(max_queue_depth))
    return events.withColumn("shed", over & (shed_priority("severity") < F.lit(min_priority)))


def backlog_depth(events: DataFrame, bucket: Column) -> DataFrame:
    """Events with ``queue_depth``: how many events share their bucket."""
    tagged = events.withColumn("_bucket", bucket)
    depth = tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("queue_depth"))
    return salted_join(tagged, depth, ["_bucket"], salt="event_id").drop("_bucket")


def sample(df: DataFrame, rate: float, key: str = "event_id", seed: int = 0) -> DataFrame:
    """Add ``sampled``: a seeded Bernoulli draw per key, the same under any partitioning."""
    require(0.0 < rate <= 1.0, "rate must be in (0, 1]")
    return df.withColumn("sampled", hash_uniform(key, seed=seed) < F.lit(float(rate)))


def replay(history: DataFrame, pipeline: str, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Totals of one pipeline's runs in ``[start, end]``; ``limit`` keeps the newest runs first."""
    rows = history.filter(
        (F.col("pipeline") == pipeline)
        & F.col("recorded_at").between(instant(start), instant(end))
    )
    if limit is not None:
        rows = rows.orderBy(F.desc("recorded_at"), F.desc("run_id")).limit(limit)
    n, ok = F.count(F.lit(1)), F.count_if("passed")
    return rows.agg(
        n.alias("total"),
        (n - ok).alias("failures"),
        F.coalesce(F.try_divide(ok, n), F.lit(0.0)).alias("pass_rate"),
    )


def pending_requeue(queue: DataFrame, max_attempts: int = 3) -> DataFrame:
    return queue.filter(F.col("attempts") < F.lit(max_attempts))


def retain(
    history: DataFrame,
    now: str | Column,
    max_age_hours: float = 168,
    max_entries: int = 1000,
    order: Sequence[str] = ("recorded_at", "run_id"),
) -> DataFrame:
    """Rows young enough, then the newest ``max_entries`` of them."""
    require(max_entries >= 1, "max_entries must be >= 1")
    require(max_age_hours > 0, "max_age_hours must be > 0")
    young = history.filter(F.col("recorded_at") >= plus_seconds(instant(now), -3600.0 * max_age_hours))
    return young.orderBy(*[F.desc(c) for c in order]).limit(max_entries)


def retention_counts(
    history: DataFrame, now: str | Column, max_age_hours: float = 168, max_entries: int = 1000
) -> DataFrame:
    """Rows removed by age, removed by the cap, and left."""
    young = F.col("recorded_at") >= plus_seconds(instant(now), -3600.0 * max_age_hours)
    n_young = F.count_if(F.coalesce(young, F.lit(False)))
    return history.agg(
        (F.count(F.lit(1)) - n_young).alias("removed_by_age"),
        F.greatest(n_young - F.lit(max_entries), F.lit(0)).alias("removed_by_cap"),
        F.least(n_young, F.lit(max_entries)).alias("remaining"),
    )


def archive_flag(entries: DataFrame, ts_text: str, now: str | Column, max_age_hours: float = 168) -> DataFrame:
    """Add ``archived``: older than the limit; a missing or unreadable time counts as the epoch."""
    require(max_age_hours > 0, "max_age_hours must be > 0")
    parsed = F.coalesce(
        F.try_to_timestamp(F.col(ts_text)), F.timestamp_seconds(F.lit(0))
    )
    cutoff = micros(instant(now)) - F.lit(int(max_age_hours * 3_600_000_000))
    return entries.withColumn("archived", micros(parsed) < cutoff)


def latest_valid(
    results: DataFrame, now: str | Column, ttl_seconds: float = 300, keys: Sequence[str] = ("pipeline", "check_name")
) -> DataFrame:
    """The last result per key that is still within its time to live."""
    require(ttl_seconds > 0, "ttl_seconds must be > 0")
    last = results.groupBy(*keys).agg(
        F.max_by(
            F.struct("event_id", "status", "value"), F.struct("triggered_at", "event_id")
        ).alias("_r"),
        F.max("triggered_at").alias("cached_at"),
    )
    expires = plus_seconds("cached_at", ttl_seconds)
    return last.filter(instant(now) < expires).select(
        *keys, "_r.event_id", "_r.status", "_r.value", "cached_at", expires.alias("expires_at")
    )


# Named schedules and their five fields (day-of-week 0 is Monday).
SCHEDULE_ALIASES = {
    "@hourly": "0 * * * *",
    "@daily": "0 0 * * *",
    "@midnight": "0 0 * * *",
    "@weekly": "0 0 * * 0",
    "@monthly": "0 0 1 * *",
}


def _field_due(field: Column, value: Column) -> Column:
    """Does a calendar value satisfy ``*``, ``*/n``, ``n-m`` or ``n``? Any other field is an error."""
    step = F.regexp_extract(field, r"^\*/(\d+)$", 1).try_cast("int")
    low = F.regexp_extract(field, r"^(\d+)-\d+$", 1).try_cast("int")
    high = F.regexp_extract(field, r"^\d+-(\d+)$", 1).try_cast("int")
    one = F.regexp_extract(field, r"^(\d+)$", 1).try_cast("int")
    return (
        F.when(field == "*", True)
        .when(step.isNotNull(), F.try_mod(value, step) == 0)
        .when(low.isNotNull(), value.between(low, high))
        .when(one.isNotNull(), value == one)
        .otherwise(F.raise_error(F.concat(F.lit("unsupported schedule field: "), field)).cast("boolean"))
    )


def due_minutes(schedules: DataFrame, start: str, end: str) -> DataFrame:
    """One row per schedule and due minute in ``[start, end]``.

    The due hours and minutes of a schedule are two short lists; days that
    satisfy the date fields are expanded by them, so only due rows are made. An
    expression that has not five fields, or a field of another form, is an error.
    """
    expr = F.col("expression")
    for alias, fields in SCHEDULE_ALIASES.items():
        expr = F.when(F.col("expression") == alias, fields).otherwise(expr)
    s0, s1 = instant(start), instant(end)
    fields = F.split(F.trim(expr), r"\s+")
    wrong = F.raise_error(F.concat(F.lit("a schedule must have five fields: "), F.coalesce("expression", F.lit("null"))))
    fields = F.when(F.size(fields) == 5, fields).otherwise(wrong.cast("array<string>"))
    # Every field is looked at, also where another one already rules the time out.
    checked = F.forall(fields, lambda f: _field_due(f, F.lit(0)).isNotNull())
    parts = schedules.withColumn("_f", F.when(checked, fields))
    listed = parts.withColumns(
        {
            "_minutes": F.filter(F.sequence(F.lit(0), F.lit(59)), lambda m: _field_due(F.col("_f")[0], m)),
            "_hours": F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: _field_due(F.col("_f")[1], h)),
        }
    )
    days = listed.withColumn(
        "_day", F.explode(F.sequence(s0.cast("date"), s1.cast("date"), F.expr("interval 1 day")))
    ).filter(
        _field_due(F.col("_f")[2], F.dayofmonth("_day"))
        & _field_due(F.col("_f")[3], F.month("_day"))
        & _field_due(F.col("_f")[4], F.weekday("_day"))
    )
    due = days.withColumn("_h", F.explode("_hours")).withColumn("_m", F.explode("_minutes"))
    at = F.col("_day").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.col("_h"), F.col("_m"), F.lit(0).cast("decimal(18,6)")
    )
    return due.withColumn("due_at", at).drop("_f", "_minutes", "_hours", "_day", "_h", "_m").filter(
        F.col("due_at").between(s0, s1)
    )


def missed_runs(due: DataFrame, runs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Due minutes in which the schedule's pipeline had no run.

    With the bounds of ``due``, runs outside of them are left out before anything is compared.
    """
    if start is not None and end is not None:
        last = plus_seconds(instant(end), 60.0)
        runs = runs.filter((F.col("triggered_at") >= instant(start)) & (F.col("triggered_at") < last))
    asked = due.select("pipeline").distinct()
    seen = runs.join(asked, "pipeline", "left_semi").select(
        "pipeline", F.date_trunc("minute", "triggered_at").cast("timestamp_ntz").alias("due_at")
    ).distinct()
    return due.join(seen, ["pipeline", "due_at"], "left_anti")
