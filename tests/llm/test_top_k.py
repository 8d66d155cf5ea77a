import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import topk


def brute(rows, k):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {(i, tuple(v)) for i, v in ok if i % 10 == 0}
    out = []
    for q, v in asked:
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("query_rows,candidate_rows", [(512, 1024), (3, 7)])
def test_top_k(spark, query_rows, candidate_rows):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=40).astype(np.float32)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(10, rows[10][1]), (20, rows[3][1])]  # repeated ids
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan"), 1.0]), (330, [float("inf"), 1.0]), (None, [1.0, 2.0]),
             (340, [1.0, -2.0]), (341, [0.5, 0.25]), (350, []), (360, [3e12, 1.0]), (361, [-1.0, 5.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, block int, ids int")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df.repartition(3), F.col("vec_id") % 10 == 0, 10, query_rows=query_rows, candidate_rows=candidate_rows)
    assert sorted(map(tuple, got.collect())) == brute(exact, 10)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 10 == 0, 10).count() == 0


def test_bounds_drop_candidates():
    rng = np.random.default_rng(1)
    columns = rng.integers(-50, 50, (64, 500))
    columns[:, :20] *= 20
    ids = np.arange(500)
    place, found, score = topk.best_of_pair(np.array([-1]), columns[:, :1], ids, columns, 5)
    want = sorted(zip((-(columns[:, 0] @ columns)).tolist(), ids.tolist()))[:5]
    assert list(zip((-score).tolist(), found.tolist())) == want and set(place) == {0}
