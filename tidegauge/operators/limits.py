"""Newest rows, pages and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.common import require, written

MAX_PAGE_SIZE = 500
# Rows before a page that are still sorted with it.
DEEP_ROWS = 10_000


def recent(df: DataFrame, order: Sequence[str], limit: int = 50, pipeline: str | None = None) -> DataFrame:
    """The newest ``limit`` rows (distributed top-n), optionally of one pipeline."""
    require(limit >= 1, "limit must be >= 1")
    rows = df if pipeline is None else df.filter(F.col("pipeline") == pipeline)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(limit)


def _page_check(page: int, page_size: int) -> None:
    require(page >= 1, "page must be >= 1")
    require(1 <= page_size <= MAX_PAGE_SIZE, f"page_size must be in 1..{MAX_PAGE_SIZE}")


def page(
    df: DataFrame, order: Sequence[str | Column], page: int = 1, page_size: int = 20, deep_rows: int = DEEP_ROWS
) -> DataFrame:
    """One page of rows in a total order.

    A page behind more than ``deep_rows`` rows is found by an index of ranks (when the order
    is of column names), so that as few rows are sorted for it as for the first page.
    """
    _page_check(page, page_size)
    offset = (page - 1) * page_size
    if offset > deep_rows and all(isinstance(c, str) for c in order):
        return _deep_page(df, list(order), offset, page_size)
    return df.orderBy(*order).offset(offset).limit(page_size)


def _deep_page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """The page from the rows between the bounds of the range partitions that hold it.

    The order columns are written by range partition; of each partition its number of rows,
    first and last values are known then.
    """
    mark = F.struct(*order)
    ranged = df.select(*order).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = written(ranged, "page-index").groupBy("_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min(mark).alias("_low"), F.max(mark).alias("_high"))
    # A row for each partition.
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    held = parts.withColumn("_before", before).filter(
        (F.col("_before") < F.lit(offset + size)) & (F.col("_before") + F.col("_n") > F.lit(offset)))
    held = written(held.agg(F.min("_before").alias("_before"), F.min("_low").alias("_low"), F.max("_high").alias("_high")), "page-bounds")
    skipped = held.first()["_before"]
    if skipped is None:
        return df.limit(0)
    # One row.
    rows = df.join(F.broadcast(held.select("_low", "_high")), (mark >= F.col("_low")) & (mark <= F.col("_high")))
    return rows.drop("_low", "_high").orderBy(*order).offset(offset - skipped).limit(size)


def page_after(df: DataFrame, order: Sequence[str], last_seen: Sequence[object], page_size: int = 20) -> DataFrame:
    """The page after the row with the given order values: a filter and a top-n, at any depth."""
    _page_check(1, page_size)
    seen = [F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, last_seen)]
    after = F.struct(*order) > F.struct(*[v.alias(c) for c, v in zip(order, seen)])
    # The bare first-column bound is what a scan can use to skip files.
    bound = F.col(order[0]) >= seen[0]
    return df.filter(bound & after).orderBy(*order).limit(page_size)


def page_info(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Totals that go with a page."""
    _page_check(page, page_size)
    n = F.count(F.lit(1))
    pages = F.greatest(F.lit(1), F.ceil(n / F.lit(page_size)))
    return df.agg(
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        n.alias("total"),
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def rank_pairs(pairs: DataFrame) -> DataFrame:
    """Strongest correlation first, then by name."""
    return pairs.orderBy(F.desc(F.abs("score")), "pipeline_a", "pipeline_b")
