"""Exact deduplication by skew-safe combining.

Texts are combined in three steps, each of which groups on the digest *and* the full
text, so equal digests of different texts are never merged:

1. every input task combines its own rows (the partial aggregation of the salted step);
2. what the tasks found is merged per (digest, salt), the salt being the number of the
   task modulo ``salts``: a text with any number of copies meets at most
   tasks / salts rows in one place;
3. the at most ``salts`` winners of a text are combined per digest.

Definitions. A null text counts as the empty text. The greatest id of a group stays; a
null id is below every other. ``label`` marks *every* row that repeats the winning id as
kept, as it cannot tell them apart; ``keep`` returns exactly one row per text, among
rows with the same id the one with the greatest other values. Extra columns of any name
and type pass through ``keep``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import own_name, saved, text_or_empty

SALTS = 32


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``row`` (all columns but the text, and whether that is null), ``id``, ``text``, ``digest``."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(
        F.struct(F.col(f"`{text_col}`").isNull().alias(own_name(docs.columns, "no_text")), *others).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        text_or_empty(f"`{text_col}`").alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _salted(docs: DataFrame, id_col: str, text_col: str, salts: int, *aggregates: Column) -> DataFrame:
    return (
        _keyed(docs, id_col, text_col)
        .withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "text")
        .agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"), *aggregates)
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: ``digest``, ``keep_id``, ``group_size`` and ``text``.

    ``text`` is null except where two different texts share a digest.
    """
    texts = (
        _salted(docs, id_col, text_col, salts)
        .repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )
    # All texts of a digest are in one place, so they are counted without another exchange.
    alone = F.count("*").over(Window.partitionBy("digest")) == 1
    return texts.select("digest", "keep_id", "group_size", F.when(~alone, F.col("text")).alias("text"))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Every row as ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Groups with more than a thousandth of all rows number less than a thousand and are
    broadcast; rows of smaller groups meet theirs by an exchange on the digest. The text
    takes part in that only if some digest stands for several texts.
    """
    found = saved(groups(docs, id_col, text_col, salts), "exact-groups")
    totals = found.agg(F.sum("group_size"), F.count("text")).first()
    rows, ambiguous = totals[0] or 0, totals[1] > 0
    keyed = _keyed(docs, id_col, text_col).select("id", "digest", *["text"] * ambiguous)
    named = found.select(F.col("digest").alias("g_digest"), "keep_id", "group_size", F.col("text").alias("g_text"))
    same = F.col("digest") == F.col("g_digest")
    if ambiguous:
        same = same & (F.col("g_text").isNull() | (F.col("text") == F.col("g_text")))
    large = F.col("group_size") * 1000 > rows
    hot = F.broadcast(named.where(large))
    parts = [
        keyed.join(hot, same),
        keyed.join(hot, same, "left_anti").join(named.where(~large), same),
    ]
    return parts[0].unionByName(parts[1]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One whole row per different text, in the columns of ``docs``."""
    best = F.struct(F.col("id"), F.to_json("row"))
    null_text = F.col(f"row.`{own_name(docs.columns, 'no_text')}`")
    text = F.when(~null_text, F.col("text"))
    return (
        _salted(docs, id_col, text_col, salts, F.max_by("row", best).alias("row"), F.max(best).alias("best"))
        .groupBy("digest", "text")
        .agg(F.max_by("row", "best").alias("row"))
        .select(*[(text if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    )
