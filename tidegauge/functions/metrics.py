"""Numeric column functions: named transforms, changes, scores and delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.common import col, require


def _truncate(x: Column) -> Column:
    return x.cast("bigint").cast("double")


# Named transforms. "floor" and "ceil" both truncate toward zero; the exact forms
# are "true_floor" and "true_ceil".
TRANSFORMS = {
    "abs": F.abs,
    "negate": lambda x: -x,
    "round": lambda x: F.bround(x, 0),
    "floor": _truncate,
    "ceil": _truncate,
    "log10": lambda x: F.when(x > 0, F.log10(x)).otherwise(F.when(x.isNotNull(), 0.0)),
    "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)).otherwise(F.when(x.isNotNull(), 0.0)),
    "true_floor": lambda x: F.floor(x).cast("double"),
    "true_ceil": lambda x: F.ceil(x).cast("double"),
}


def transformed(value: str | Column, fn: str = "abs", scale: float = 1.0, offset: float = 0.0) -> Column:
    """``fn(value * scale + offset)``."""
    require(fn in TRANSFORMS, f"unknown transform {fn!r}")
    require(scale != 0, "scale must not be 0")
    return TRANSFORMS[fn](col(value) * F.lit(float(scale)) + F.lit(float(offset)))


def delta(current: str | Column, previous: str | Column) -> Column:
    return col(current) - col(previous)


def pct_change(current: str | Column, previous: str | Column) -> Column:
    """Change in percent of ``abs(previous)``; null when that is zero."""
    return F.try_divide(delta(current, previous), F.abs(col(previous))) * 100


def signed_pct_change(current: str | Column, previous: str | Column) -> Column:
    """Change in percent of the signed previous value, to two digits; null when it is zero."""
    return F.round(F.try_divide(delta(current, previous), col(previous)) * 100, 2)


def base_priority(severity: str | Column) -> Column:
    s = col(severity)
    return F.when(s == "critical", 100).when(s == "warning", 50).otherwise(10)


def recurrence_bonus(recurrence: str | Column, weight: int = 5, cap: int = 50) -> Column:
    return F.least(F.lit(weight) * F.greatest(col(recurrence) - 1, F.lit(0)), F.lit(cap))


def tag_bonus(tags: str | Column, high_priority: Sequence[str], bonus: int = 20) -> Column:
    if not high_priority:
        return F.lit(0)
    hit = F.arrays_overlap(col(tags), F.array(*[F.lit(t) for t in high_priority]))
    return F.when(hit, bonus).otherwise(0)


def retry_delay(attempt: str | Column, base: float = 60, multiplier: float = 2, cap: float = 3600) -> Column:
    """Seconds before the given (1-based) attempt."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(float(multiplier)), col(attempt) - 1), F.lit(float(cap)))


def jittered(
    delay: str | Column,
    uniform: Column,
    strategy: str = "full",
    low: float = 0.0,
    high: float = 30.0,
) -> Column:
    """A delay with jitter from a uniform [0, 1) column, clipped to ``[low, high]``."""
    require(strategy in ("full", "equal", "decorrelated"), f"unknown strategy {strategy!r}")
    require(0 <= low < high, "need 0 <= low < high")
    lo, hi = F.lit(float(low)), F.lit(float(high))
    d = col(delay).cast("double")
    top = F.greatest(lo, F.least(d, hi))
    if strategy == "full":
        out = lo + uniform * (top - lo)
    elif strategy == "equal":
        out = top / 2 + uniform * (top / 2)
    else:
        wide = F.greatest(lo, F.least(d * 3, hi))
        out = lo + uniform * (wide - lo)
    return F.greatest(lo, F.least(out, hi))
