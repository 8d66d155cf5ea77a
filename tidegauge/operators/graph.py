"""Dependency edges: neighbours, nodes and cycles."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.common import written


def upstream_of(edges: DataFrame, pipeline: str) -> DataFrame:
    return edges.filter(F.col("downstream") == pipeline).select(F.col("upstream").alias("pipeline"))


def downstream_of(edges: DataFrame, pipeline: str) -> DataFrame:
    return edges.filter(F.col("upstream") == pipeline).select(F.col("downstream").alias("pipeline"))


def degrees(edges: DataFrame) -> DataFrame:
    """Upstream and downstream counts of every pipeline."""
    one, none = F.lit(1), F.lit(0)
    ends = F.array(
        F.struct(F.col("upstream").alias("pipeline"), none.alias("i"), one.alias("o")),
        F.struct(F.col("downstream").alias("pipeline"), one.alias("i"), none.alias("o")),
    )
    return edges.select(F.inline(ends)).groupBy("pipeline").agg(
        F.sum("i").alias("upstream_count"), F.sum("o").alias("downstream_count")
    )


def all_pipelines(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("upstream").alias("pipeline")).union(edges.select("downstream")).distinct()


#: Peeling rounds that are planned together; their result is written once. Every round reads
#: what it starts from three times, so there are few.
ROUNDS = 2


def _peeled(left: DataFrame) -> DataFrame:
    """Without the edges that start at a source or end at a sink."""
    inner = degrees(left).filter("upstream_count > 0 and downstream_count > 0").select("pipeline")
    for end in ("upstream", "downstream"):
        left = left.join(inner.withColumnRenamed("pipeline", end), end, "left_semi")
    return left.select("upstream", "downstream")


def _contracted(edges: DataFrame, seed: int) -> DataFrame:
    """Chains halved: a node with one edge in and one out gives way to an edge from its upstream to its downstream.

    Of neighbours that could both give way, a coin picks nodes of which no two are
    adjacent. Cycles stay cycles; one of which all nodes give way becomes a self-loop.
    """
    slim = degrees(edges).filter("upstream_count = 1 and downstream_count = 1").select("pipeline")
    coin = F.pmod(F.xxhash64("pipeline", F.lit(seed)), F.lit(2)) == 1
    slim = slim.filter(coin)
    into = edges.join(slim, edges.downstream == slim.pipeline, "left_semi").filter("upstream <> downstream")
    # A node goes if the one before it stays.
    first = into.join(slim, into.upstream == slim.pipeline, "left_anti")
    gone = first.select(F.col("downstream").alias("pipeline"), F.col("upstream").alias("before"))
    out = edges.join(gone.select(F.col("pipeline").alias("downstream")), "downstream", "left_anti")
    out = out.join(gone, out.upstream == gone.pipeline, "left")
    return out.select(F.coalesce("before", "upstream").alias("upstream"), "downstream").distinct()


#: Edges that one task takes to the end, in time proportional to their number.
FEW_EDGES = 200_000


def _kahn(start: np.ndarray, end: np.ndarray, nodes: int) -> np.ndarray:
    """The edges that are left when nodes without an edge into them are taken off one by one."""
    order = np.argsort(start, kind="stable")
    first = np.searchsorted(start[order], np.arange(nodes + 1)).tolist()
    to, into = end[order].tolist(), np.bincount(end, minlength=nodes)
    open_, into = np.flatnonzero(into == 0).tolist(), into.tolist()
    gone = np.zeros(nodes, bool)
    while open_:
        node = open_.pop()
        gone[node] = True
        for other in to[first[node] : first[node + 1]]:
            into[other] -= 1
            if not into[other]:
                open_.append(other)
    return ~gone[start]


def _core(edges: pd.DataFrame) -> pd.DataFrame:
    edges = edges.dropna()
    codes, names = pd.factorize(pd.concat([edges["upstream"], edges["downstream"]]))
    start, end = codes[: len(edges)], codes[len(edges) :]
    kept = np.arange(len(edges))
    for _ in range(2):  # from the sources, then the other way round from the sinks
        kept = kept[_kahn(start[kept], end[kept], len(names))]
        start, end = end, start
    return edges.iloc[kept]


def _finished(left: DataFrame) -> DataFrame:
    """The same peeling to the end, of at most ``FEW_EDGES`` edges."""
    return left.select("upstream", "downstream").groupBy().applyInPandas(_core, left.schema)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """What is left after peeling off, again and again, edges that start at a source or end at a sink.

    Empty exactly when the graph has no cycle; a self-loop stays. Both ends are
    peeled, so the number of rounds is half the longest path outside cycles; once
    there are few edges left, one task does the rest.
    """
    left = written(edges.select("upstream", "downstream").distinct(), "edges")
    size = left.count()
    while size:
        if size <= FEW_EDGES:
            return written(_finished(left), "edges")
        for _ in range(ROUNDS):
            left = _peeled(left)
        left = written(left, "edges")
        now = left.count()
        if now == size:
            break
        size = now
    return left


def has_cycle(edges: DataFrame) -> DataFrame:
    """One row: is there a directed cycle?

    Peels as ``cyclic_edges`` does, to where one task does the rest. When a round takes off less than a tenth, chains are
    halved too, so that a long chain takes as many rounds as its length has binary digits.
    """
    left = written(edges.select("upstream", "downstream").distinct(), "edges")
    size, number = left.count(), 0
    while size and left.filter("upstream = downstream").isEmpty():
        if size <= FEW_EDGES:
            left = _finished(left)
            break
        for _ in range(ROUNDS):
            left = _peeled(left)
        left = written(left, "edges")
        now = left.count()
        if now * 10 > size * 9:
            chains = degrees(left).filter("upstream_count = 1 and downstream_count = 1")
            if now == size and chains.isEmpty():
                break
            left = written(_contracted(left, number), "edges")
            now, number = left.count(), number + 1
        size = now
    return left.agg((F.count(F.lit(1)) > 0).alias("has_cycle"))


# The functions of tasks are pickled by value, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
