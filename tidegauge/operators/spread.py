"""Ordered computations per key that stay parallel when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task. Here the
keys with more than ``max_rows`` rows (there are at most ``rows / max_rows`` of
them) are cut into chunks: they are range-partitioned by (key, order) and
checkpointed, so each chunk is one contiguous run of one order, and window
expressions run per (key, chunk). What a chunk needs from the chunks before it
is one small row, found from per-chunk aggregates. Frequent and infrequent
keys go through the same expressions; infrequent keys are one chunk each.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.common import ensure_checkpoint_dir, null_safe_on

# A key with more rows than this is cut into chunks of about this size.
MAX_ROWS = 4_000_000
# Values of chunks that are broadcast at most (8 MB).
CARRIED_VALUES = 1_000_000

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


class Spread:
    """``df`` with a ``_chunk`` column (0 for infrequent keys) and hot-key-safe running values.

    The set of frequent keys is measured by one aggregate over the key columns;
    pass ``max_rows=None`` to skip it when no key can be frequent.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        max_rows: int | None = MAX_ROWS,
    ) -> None:
        self.keys, self.order = list(keys), list(order)
        self.hot = False
        if max_rows is not None:
            counts = df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
            frequent = counts.filter(F.col("_n") > F.lit(max_rows))
            size = frequent.agg(F.sum("_n")).first()[0]
            self.hot = size is not None
        if not self.hot:
            self.df = df.withColumn("_chunk", F.lit(0))
            return
        ensure_checkpoint_dir(df.sparkSession)
        hot_keys = F.broadcast(frequent.select(*self.keys).checkpoint())
        on = null_safe_on(df, hot_keys, self.keys)
        self.chunks = int(2 * -(-size // max_rows))
        cut = (
            df.join(hot_keys, on, "left_semi")
            .repartitionByRange(self.chunks, *self.keys, *self.order)
            .withColumn("_chunk", F.spark_partition_id() + F.lit(1))
            .checkpoint()
        )
        self.hot_rows = cut
        self.df = df.join(hot_keys, on, "left_anti").withColumn("_chunk", F.lit(0)).unionByName(cut)

    def _window(self):
        return Window.partitionBy(*self.keys, "_chunk").orderBy(*self.order)

    def _attach(self, carry: DataFrame, names: Sequence[str], width: int = 1) -> DataFrame:
        """Join per-chunk values, of ``width`` numbers each.

        There is at most one continued key per chunk, so the number of chunks bounds the
        size. If that is small the values are broadcast; else chunks, which are of even
        size, are joined on equality.
        """
        right = carry.select(*[F.col(k).alias(f"_k_{k}") for k in (*self.keys, "_chunk")], *names)
        cond = F.col("_chunk") == F.col("_k__chunk")
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        drop = [f"_k_{k}" for k in (*self.keys, "_chunk")]
        if self.chunks * width <= CARRIED_VALUES:
            right = F.broadcast(right)
        return self.df.join(right, cond, "left").drop(*drop)

    def _per_chunk(self, *aggregates: Column) -> DataFrame:
        return self.df.filter(F.col("_chunk") > 0).groupBy(*self.keys, "_chunk").agg(*aggregates)

    def _chunk_window(self):
        return Window.partitionBy(*self.keys).orderBy("_chunk")

    def running(self, **specs: tuple[str, Column]) -> Spread:
        """Add inclusive running values: ``name=("sum" | "max" | "min", column)``."""
        w = self._window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = {n: _COMBINE[f](c).over(w) for n, (f, c) in specs.items()}
        if not self.hot:
            self.df = self.df.withColumns(local)
            return self
        names = list(specs)
        before = self._chunk_window().rowsBetween(Window.unboundedPreceding, -1)
        totals = self._per_chunk(*[_COMBINE[f](c).alias(n) for n, (f, c) in specs.items()])
        carry = totals.select(
            *self.keys,
            "_chunk",
            F.row_number().over(self._chunk_window()).alias("_nth"),
            *[_COMBINE[f](n).over(before).alias(f"_in_{n}") for n, (f, _) in specs.items()],
        ).filter("_nth > 1")
        joined = self._attach(carry, [f"_in_{n}" for n in names])
        merged = {}
        for n, (f, _) in specs.items():
            here, there = local[n], F.col(f"_in_{n}")
            if f == "sum":
                both = F.coalesce(here + there, here, there)
            else:
                both = (F.greatest if f == "max" else F.least)(here, there)
            merged[n] = both
        self.df = joined.withColumns(merged).drop(*[f"_in_{n}" for n in names])
        return self

    def position(self, name: str = "position") -> Spread:
        """Add the 1-based row number within the key."""
        return self.running(**{name: ("sum", F.lit(1).cast("bigint"))})

    def lag(self, **columns: str) -> Spread:
        """Add the previous row's values within the key: ``new_name="column"``."""
        row = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        prev = F.lag(row).over(self._window())
        if self.hot:
            ends = self._per_chunk(F.max_by(row, F.struct(*self.order)).alias("_end"))
            carry = ends.select(
                *self.keys, "_chunk", F.lag("_end").over(self._chunk_window()).alias("_in_prev")
            ).filter("_in_prev is not null")
            self.df = self._attach(carry, ["_in_prev"])
            prev = F.coalesce(prev, F.col("_in_prev"))
        out = self.df.withColumn("_prev", prev).withColumns(
            {n: F.col(f"_prev.{n}") for n in columns}
        )
        self.df = out.drop("_prev", "_in_prev")
        return self

    def with_context(self, rows: int) -> DataFrame:
        """All rows with ``_context``: false, and true for copies of the ``rows`` rows before each chunk.

        A window of so many rows back is then whole inside a (key, chunk).
        """
        own = self.df.withColumn("_context", F.lit(False))
        if not self.hot:
            return own
        numbered = copy(self)
        numbered.df = self.df.filter(F.col("_chunk") > 0)
        # The position is taken once more from the chunks, which are checkpointed.
        placed = numbered.position("_pos").df
        spans = placed.groupBy(*self.keys, "_chunk").agg(F.min("_pos").alias("_start"), F.max("_pos").alias("_end"))
        numbered.df = placed
        near = numbered._attach(spans.drop("_start"), ["_end"], 2).filter(F.col("_pos") > F.col("_end") - rows)
        # A row is before the chunks that start within ``rows`` of it; there is one chunk for a start.
        near = near.drop("_end", "_chunk").withColumn("_at", F.explode(F.sequence(F.col("_pos") + 1, F.col("_pos") + rows)))
        starts = spans.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], F.col("_chunk").alias("_to"), "_start")
        cond = F.col("_at") == F.col("_start")
        for k in self.keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        copies = near.join(starts, cond).withColumn("_chunk", F.col("_to")).withColumn("_context", F.lit(True))
        return own.unionByName(copies.select(*own.columns))

    def with_columns(self, columns: dict[str, Column]) -> Spread:
        self.df = self.df.withColumns(columns)
        return self

    def result(self) -> DataFrame:
        return self.df.drop("_chunk")
