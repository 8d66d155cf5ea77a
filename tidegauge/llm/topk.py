"""Exact top-k inner products by columnar branch and bound.

Vectors are rounded to integers and packed into blocks that store one dimension after
the other. Blocks of queries meet blocks of candidates; within such a pair the scores of
all candidates grow by a few dimensions at a time. What the remaining dimensions can add
is at most the product of the remaining lengths of both vectors. A candidate whose
best possible score is below the k-th best guaranteed one is dropped, and the columns
that follow are read for the surviving candidates only.

Definitions. A component x counts as floor(1024 x), computed in double precision. Rows
without id, with a null vector, or with a null or non-finite component take no part.
Only vectors of the same length are compared. A candidate with the query's own id is left
out; repeated ids are candidates each. Ties go to the smaller id. Extra columns are
ignored. An empty table, or no query, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import by_value, saved

SCALE = 1024.0
QUERY_ROWS, CANDIDATE_ROWS, STEP = 512, 1024, 16

_BLOCK = "dims int, block long, ids binary, columns binary"
_FOUND = "query_row long, query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array<long>) of the rows that take part."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0))
        .where(~bad)
        .select("id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))
    )


def blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Integer vectors in blocks of at most ``rows`` per task and Arrow batch, column by column."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = np.asarray(batch.column(0), dtype=np.int64)
            lists = batch.column(1)
            sizes = np.asarray(pc.list_value_length(lists), dtype=np.int64)
            flat, starts = np.asarray(lists.flatten(), dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)])
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                for i in range(0, len(own), rows):
                    take = own[i : i + rows]
                    matrix = flat[starts[take][:, None] + np.arange(dims)[None, :]].T
                    small = np.abs(matrix).max() < 2**31
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([dims], pa.int32()),
                            pa.array([serial], pa.int64()),
                            pa.array([ids[take].tobytes()], pa.binary()),
                            pa.array([np.ascontiguousarray(matrix, np.int32 if small else np.int64).tobytes()], pa.binary()),
                        ],
                        names=["dims", "block", "ids", "columns"],
                    )
                    serial += 1

    return vectors.mapInArrow(pack, _BLOCK)


def _unpacked(dims: int, ids: bytes, columns: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    dtype = np.int32 if len(columns) == 4 * dims * len(ids) else np.int64
    return ids, np.frombuffer(columns, dtype).reshape(dims, len(ids)).astype(np.int64)


def _rests(m: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """Length of what each vector (a column) still has from every cut on, rounded up a little."""
    tail = np.cumsum(m[::-1].astype(np.float64) ** 2, axis=0)[::-1]
    return [np.sqrt(tail[c]) * (1 + 1e-9) if c < len(m) else np.zeros(m.shape[1]) for c in cuts]


def best_of_pair(
    q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, columns: np.ndarray, k: int, step: int = STEP
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in a pair of blocks: (place of the query, candidate id, score).

    Both matrices have a row per dimension.
    """
    dims = columns.shape[0]
    cuts = [*range(0, dims, step), dims]
    c_rest, q_rest = _rests(columns, cuts), _rests(queries, cuts)
    out = [(np.zeros(0, np.int64),) * 3]
    for i, own in enumerate(q_ids):
        q = queries[:, i]
        alive = np.flatnonzero(c_ids != own)
        score = np.zeros(len(alive), dtype=np.int64)
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            block = columns[a:b] if len(alive) == columns.shape[1] else columns[a:b][:, alive]
            score += q[a:b] @ block
            if len(alive) > k and b < dims:
                more = q_rest[n + 1][i] * c_rest[n + 1][alive] + 1
                sure = np.partition(score - more, len(alive) - k)[len(alive) - k]
                live = score + more >= sure
                alive, score = alive[live], score[live]
        top = np.lexsort((c_ids[alive], -score))[:k]
        out.append((np.full(len(top), i), c_ids[alive[top]], score[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def top_k(
    vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding",
    query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """The ``k`` best candidates of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    A block of candidates is sent once for each block of queries, and a block of queries
    once for each bucket of candidate blocks; nothing is broadcast by hint.
    """
    asked = integer_vectors(vectors.where(is_query), id_col, vector_col).dropDuplicates(["id", "v"])
    asked = saved(asked, "topk-asked")
    n = max(1, -(-asked.count() // query_rows))
    q = saved(blocks(asked.repartition(n), query_rows), "topk-queries")
    c = saved(blocks(integer_vectors(vectors, id_col, vector_col), candidate_rows), "topk-candidates")
    buckets = max(1, -(-c.count() // 4))
    left = c.select(
        "dims", "ids", "columns",
        F.pmod(F.xxhash64("block"), F.lit(buckets)).alias("bucket"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("q_part"),
    )
    right = q.select(
        F.col("dims").alias("q_dims"), F.col("block").alias("q_block"),
        F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"),
        F.shiftright("block", 32).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))).alias("q_bucket"),
    )
    pairs = left.join(
        right,
        (F.col("bucket") == F.col("q_bucket")) & (F.col("q_part") == F.col("part")) & (F.col("dims") == F.col("q_dims")),
    ).select("dims", "q_block", "q_ids", "q_columns", "ids", "columns")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                q_ids, queries = _unpacked(row["dims"], row["q_ids"], row["q_columns"])
                c_ids, columns = _unpacked(row["dims"], row["ids"], row["columns"])
                place, found, score = best_of_pair(q_ids, queries, c_ids, columns, k)
                # A block holds fewer than 2**20 rows, so a query row has a number of its own.
                yield pa.RecordBatch.from_arrays(
                    [pa.array((row["q_block"] << 20) + place), pa.array(q_ids[place]), pa.array(found), pa.array(score)],
                    names=["query_row", "query_id", "vec_id", "score"],
                )

    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.mapInArrow(search, _FOUND)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


by_value(__name__)
