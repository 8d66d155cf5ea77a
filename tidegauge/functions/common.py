"""Shared column helpers: time arithmetic, severity ranks, globs, hashing, size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest rule or dimension table that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 20_000

# Accepted severities and check statuses.
SEVERITIES = ("info", "warning", "critical")
STATUSES = ("pass", "fail", "warn", "error")


def require(condition: bool, message: str) -> None:
    """Raise ``ValueError`` when a policy value is out of range."""
    if not condition:
        raise ValueError(message)


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value: str | Column) -> Column:
    """A zone-free timestamp from an ISO text or a column."""
    if isinstance(value, str):
        return F.to_timestamp_ntz(F.lit(value))
    return value


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch; the session time zone is expected to be UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1_000_000.0)


def plus_seconds(ts: str | Column, seconds: float | Column) -> Column:
    if not isinstance(seconds, Column):
        seconds = F.lit(float(seconds))
    return col(ts) + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def severity_rank(severity: str | Column) -> Column:
    """0 for critical, 1 for warning, 2 for everything else (lower is worse)."""
    s = col(severity)
    return F.when(s == "critical", 0).when(s == "warning", 1).otherwise(2)


def severity_of_rank(rank: Column) -> Column:
    return F.when(rank == 0, "critical").when(rank == 1, "warning").otherwise("info")


# A bracket group (a first "]" is a member), or a single character.
_GLOB_UNIT = r"(?s)\[!?+\]?+[^\]]*+\]|."


def _glob_class(unit: Column) -> Column:
    """A bracket group of a glob as a character class; ranges that run backwards are empty."""
    negated = F.substring(unit, 2, 1) == "!"
    body = F.substring(unit, F.when(negated, 3).otherwise(2), F.length(unit) - F.when(negated, 3).otherwise(2))
    escaped = lambda c: F.regexp_replace(c, r"([\\\[\]&^-])", r"\\$1")
    members = F.transform(
        F.regexp_extract_all(body, F.lit(r"(?s)(.-.|.)"), F.lit(1)),
        lambda m: F.when(F.length(m) < 3, escaped(m))
        .when(F.substring(m, 1, 1) > F.substring(m, 3, 1), "")
        .otherwise(F.concat(escaped(F.substring(m, 1, 1)), F.lit("-"), escaped(F.substring(m, 3, 1)))),
    )
    inner = F.array_join(members, "")
    return (
        F.when((inner == "") & negated, ".")
        .when(inner == "", "(?!)")
        .otherwise(F.concat(F.lit("["), F.when(negated, "^").otherwise(""), inner, F.lit("]")))
    )


def glob_regex(glob: str | Column) -> Column:
    """Shell glob (``*``, ``?``, ``[..]``, ``[!..]``) as an anchored regular expression.

    The glob is cut into bracket groups and single characters, and each is translated alone.
    """
    units = F.regexp_extract_all(col(glob), F.lit(f"({_GLOB_UNIT})"), F.lit(1))
    parts = F.transform(
        units,
        lambda u: F.when(u == "*", ".*")
        .when(u == "?", ".")
        .when(F.length(u) > 1, _glob_class(u))
        .otherwise(F.regexp_replace(u, r"([.+^$(){}|\\\[\]&*?-])", r"\\$1")),
    )
    return F.concat(F.lit("(?s)^(?:"), F.array_join(parts, ""), F.lit(")\\z"))


def is_literal_glob(glob: str | Column) -> Column:
    """True if a glob can only match itself."""
    return ~F.regexp_like(col(glob), F.lit(r"[*?\[]"))


def hash_uniform(*parts: str | Column, seed: int = 0) -> Column:
    """Uniform [0, 1) from the md5 of the parts and a seed; stable under any partitioning."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def json_text(value: str | Column) -> Column:
    """A string column as a quoted, escaped JSON string."""
    as_array = F.to_json(F.array(col(value)))
    return F.substring(as_array, F.lit(2), F.length(as_array) - F.lit(2))


# Short escapes in JSON text.
JSON_ESCAPES = {34: '\\"', 92: "\\\\", 8: "\\b", 12: "\\f", 10: "\\n", 13: "\\r", 9: "\\t"}


def ascii_json_text(value: str | Column) -> Column:
    """A string as JSON in ASCII only: all else is escaped by UTF-16 unit, in lower case; null is ``null``."""
    text = col(value)

    def unit(u: Column) -> Column:
        code = F.conv(u, 16, 10).cast("int")
        out = F.when(code.between(32, 126), F.char(code)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))
        for number, short in JSON_ESCAPES.items():
            out = F.when(code == number, F.lit(short)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1))
    plain = F.regexp_like(text, F.lit(r'^[ !#-\[\]-~]*\z'))
    inner = F.when(plain, text).otherwise(F.array_join(F.transform(units, unit), ""))
    return F.coalesce(F.concat(F.lit('"'), inner, F.lit('"')), F.lit("null"))


def order_mark(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable value per row for the given order.

    A (time, whole number) order becomes a decimal, which hash aggregation can
    take the maximum of; a struct would need a sort.
    """
    types = [df.schema[c].dataType for c in order]
    if (
        len(order) == 2
        and isinstance(types[0], (T.TimestampType, T.TimestampNTZType))
        and isinstance(types[1], (T.LongType, T.IntegerType))
    ):
        wide = micros(order[0]).cast("decimal(38,0)") * F.lit(Decimal(10) ** 20)
        return (wide + F.col(order[1]).cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def within_rows(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than ``limit + 1`` of them."""
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only behind a size check; otherwise Spark chooses a shuffled join."""
    return F.broadcast(df) if within_rows(df, limit) else df


def salted_join(
    big: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    salt: str,
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join a table with one row per key to a big table, one key of which may be very frequent.

    The one-row-per-key side is written once, so that its size is known: if it is small it
    is broadcast, and the big table is not shuffled. Else the rows of a key are spread over
    ``salts`` tasks (by default as many as there are shuffle partitions) by the hash of the
    ``salt`` column, and the other side is repeated for each.
    """
    others = [c for c in per_key.columns if c not in keys]
    per_key = written(per_key.select(*keys, *others), "per-key")
    renamed = [F.col(k).alias(f"_r_{k}") for k in keys]
    if within_rows(per_key, BROADCAST_ROWS):
        left, right, cond = big, F.broadcast(per_key.select(*renamed, *others)), F.lit(True)
    else:
        salts = salts or max(32, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        left = big.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_r__salt")
        right, cond = per_key.select(*renamed, *others, copies), F.col("_salt") == F.col("_r__salt")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop("_salt", "_r__salt", *[f"_r_{k}" for k in keys])


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def use_utc(spark: SparkSession) -> SparkSession:
    """Zone-free timestamps are read as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder inside the shared work folder, for a table that is written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared work folder and read it back; its lineage ends there."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that ``spark.checkpoint.dir`` names; it must be shared by all executors.

    Only a session whose executors are threads of the driver may leave it out. What is
    in the folder belongs to whoever named it, and is theirs to clear.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-checkpoint-"))
