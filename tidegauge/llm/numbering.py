"""Consecutive numbers for the rows of a table in a given order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import own_name, saved


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A saved table of all rows with ``name``, their place from 0 in the order of the columns ``order``.

    Rows are range-partitioned and sorted, and the partitions' row counts, one row each, give
    the first number of every partition. Rows alike in all columns of ``order`` are told apart
    by where they come from in the input, so that they, too, are spread over partitions.
    """
    tie, part, at = (own_name([*df.columns, name], c) for c in ("_tie", "_part", "_at"))
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    # Also in one partition: the sort may not be taken as that of the whole table.
    spread = spread.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie).drop(tie)
    kept = saved(spread.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}), "numbered")
    firsts = kept.groupBy(part).agg(F.count("*").alias("_rows"), F.min(at).alias("_least"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.select(
        F.col(part).alias("_own"), (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    # A row for each partition.
    return (
        kept.join(F.broadcast(firsts), F.col(part) == F.col("_own"))
        .withColumn(name, F.col(at) + F.col("_shift"))
        .drop(part, at, "_own", "_shift")
    )
