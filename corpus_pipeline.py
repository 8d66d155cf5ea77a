"""Corpus preparation: quality filter, exact and near deduplication, source mixing, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet in
the shared work folder and read again as the next stage's ``docs``. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, ngram_join, packing, quality
from tidegauge.llm.common import saved, table, with_row_key
from tidegauge.llm.queries import QUALITY_LEAST, mixed, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, accepts; without text: the bias decides."""
    labels = table(spark, sf_dir, "labels").where(~quality.held_out())
    model = quality.fit(docs, labels)
    name = "quality_score"
    return quality.score(docs.select(*COLUMNS), model, name=name).where(F.col(name) >= QUALITY_LEAST).drop(name)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, that with the greatest id."""
    return exact_dedup.keep(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays, one with the smallest id.

    Rows are told apart by a key of their own, as ids may repeat: their file and place in it,
    so that a table that is read again with other splits has the same keys. Rows without an
    id are in no component and stay.
    """
    keyed = with_row_key(docs, COLUMNS, "row_key")
    key = F.when(F.col("doc_id").isNotNull(), F.col("row_key")).alias("row_key")
    found = ngram_join.link(keyed.select(key, "text"), id_col="row_key").withColumnRenamed("doc_id", "row_key")
    found = saved(found.where(F.col("row_key").isNotNull()).select("row_key", "component_id"), "near-rows")
    first = F.min(F.struct("doc_id", "row_key")).alias("first")
    stay = found.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("component_id").agg(first)
    others = found.join(stay.select("first.row_key"), "row_key", "left_anti").select("row_key")
    return keyed.join(others, "row_key", "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come near the target weights of source, language and topic."""
    return mixed(docs).where("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("quality filter", quality_filter),
    ("exact dedup", exact),
    ("near dedup", near),
    ("source mixing", mix),
    ("packing", pack),
]

# A trained model, a similarity join and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
