"""Connected components by contraction, as tables in the shared work folder; few links in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import by_value, saved

#: So many links, each listed from both ends, are finished in one task.
FEW_LINKS = 200_000


def merge_components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node it is linked with, over any number of links).

    ``links`` has ``a`` and ``b``; nodes without a link are not in the result. In every
    round each label takes the smallest of its neighbours' labels, chains of labels are
    followed by doubling, and the links between labels are what the next round starts from.
    Once there are few links left, one task does the rest: each round is a dozen jobs, of
    which the driver keeps plans, threads and broadcasts.
    """
    both = links.select("a", "b").where(F.col("a") != F.col("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = saved(both.distinct(), "edges")
    labels = None
    while size := edges.limit(FEW_LINKS + 1).count():
        if size <= FEW_LINKS:
            step = saved(edges.groupBy().applyInPandas(_finished, "node long, label long"), "labels")
            return step if labels is None else saved(join_labels(labels, "label", step), "labels")
        step = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
        step = _followed(saved(step, "labels"))
        labels = step if labels is None else saved(join_labels(labels, "label", step), "labels")
        edges = join_labels(join_labels(edges, "a", step), "b", step)
        edges = saved(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _finished(edges: pd.DataFrame) -> pd.DataFrame:
    """The same rounds to the end, of at most ``FEW_LINKS`` links."""
    nodes, ends = np.unique(edges[["a", "b"]].to_numpy(np.int64).T.ravel(), return_inverse=True)
    a, b = ends[: len(edges)], ends[len(edges) :]
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        # A label stands for all its nodes, so it is the label that gets the smaller one.
        np.minimum.at(label, label[a], label[b])
        while (label[label] != label).any():
            label = label[label]
    return pd.DataFrame({"node": nodes, "label": nodes[label]})


def _followed(step: DataFrame) -> DataFrame:
    """Follow labels to their end; a label is never greater than its node, so there are no circles."""
    while True:
        after = saved(join_labels(step, "label", step).withColumnRenamed("label", "next")
                      .join(step, "node").select("node", "label", "next"), "labels")
        if after.where(F.col("label") != F.col("next")).isEmpty():
            return step
        step = after.select("node", F.col("next").alias("label"))


def join_labels(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Replace the nodes in ``column`` by their labels; nodes without one stay."""
    found = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return (
        df.join(found, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_label", column))
        .drop("_node", "_label")
    )


by_value(__name__)
