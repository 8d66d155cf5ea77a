"""Each stage of the pipeline against plain Python or SQL on what the stage before it left."""

import hashlib
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_text_operators import WORD, components, crc, encoded
from tidegauge.llm import quality, queries
from tidegauge.llm.common import saved, table


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = table(spark, folder, "documents"), []
    for name, stage in pipeline.STAGES:
        after = saved(stage(spark, docs, folder), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    assert all(after.columns == pipeline.COLUMNS for _, after in stages[:-1])


def test_quality_stage(spark, folder, stages):
    before, after = stages[0]
    accepted = queries.QUERIES["op7_quality"](spark, folder).where("predicted = 1")
    assert {r.doc_id for r in accepted.collect()} == {i for i, _ in pairs(after)}
    marks = table(spark, folder, "labels").where("quality = 1").join(before, "doc_id").count()
    assert after.join(table(spark, folder, "labels").where("quality = 1"), "doc_id").count() >= 0.97 * marks


def test_exact_stage(stages):
    before, after = stages[1]
    best = {}
    for i, t in pairs(before):
        best[t] = max(i, best.get(t, i))
    assert sorted(pairs(after)) == sorted((i, t) for t, i in best.items())


def test_near_stage(stages):
    before, after = stages[2]
    want = {c for (_, _, c) in components(pairs(before))}
    assert sorted(i for i, _ in pairs(after)) == sorted(want)


def test_mixing_stage(stages):
    before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", before.toArrow())
    want = con.sql(f"SELECT doc_id FROM ({queries.mixing_sql()}) WHERE sampled").fetchall()
    assert sorted(i for i, _ in pairs(after)) == sorted(x for (x,) in want)


def test_packing_stage(stages):
    before, after = stages[4]
    rows = pairs(before)
    ids = {i: x for (i, _), x in zip(rows, encoded(rows))}
    cover, used = Counter(), Counter()
    for r in after.collect():
        assert crc(ids[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        cover[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert cover == Counter({i: len(x) for i, x in ids.items()}) and max(used.values()) <= 2048


def test_run_is_the_chain_of_stages(spark, folder, stages):
    assert Counter(map(tuple, pipeline.run(spark, folder).collect())) == Counter(map(tuple, stages[-1][1].collect()))


def row_classes(rows):
    """Rows with an id in classes of near duplicates, each row by itself."""
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        own = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
        sets.append(own if i is not None else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = {}
    for k, row in enumerate(rows):
        out.setdefault(find(k), []).append(row)
    return list(out.values())


@pytest.fixture(scope="module")
def odd_docs(spark, make, odd_rows):
    """The odd rows, with further columns by clashing names, as a stage gets them."""
    return saved(make(odd_rows + [(20, "near one two three four five six seven eight nine ten eleven"),
                                  (21, "near one two three four five six seven eight nine ten eleven twelve")]), "test-odd")


def test_quality_stage_on_odd_rows(spark, folder, odd_docs):
    after = pipeline.quality_filter(spark, odd_docs, folder)
    labels = table(spark, folder, "labels").where(~quality.held_out())
    model = quality.fit(odd_docs, labels)
    rows = pairs(odd_docs)
    scores = quality.probabilities(model, pa.array([t for _, t in rows], pa.string()))
    assert Counter(pairs(after)) == Counter(r for r, x in zip(rows, scores) if x >= queries.QUALITY_LEAST)
    assert after.columns == pipeline.COLUMNS


def test_exact_stage_on_odd_rows(spark, folder, odd_docs):
    best = {}
    for i, t in pairs(odd_docs):
        best[t or ""] = max(-1 if i is None else i, best.get(t or "", -1))
    after = pipeline.exact(spark, odd_docs, folder)
    assert Counter((-1 if i is None else i, t or "") for i, t in pairs(after)) == Counter((i, t) for t, i in best.items())
    assert after.columns == pipeline.COLUMNS


def test_near_stage_on_odd_rows(spark, folder, odd_docs):
    rows = pairs(odd_docs)
    after = Counter(pairs(pipeline.near(spark, odd_docs, folder)))
    want = Counter(r for r in rows if r[0] is None)
    for group in row_classes([r for r in rows if r[0] is not None]):
        least = min(i for i, _ in group)
        stays = [r for r in group if r[0] == least and after[r] > want[r]]
        assert stays, group
        want[stays[0]] += 1
    assert after == want


def test_mixing_stage_on_odd_rows(spark, folder, odd_docs):
    con = duckdb.connect()
    con.register("documents", odd_docs.select(*pipeline.COLUMNS).toArrow())
    chance = con.sql(f"SELECT doc_id, topic, tokens, probability FROM ({queries.mixing_sql()})").fetchall()
    got = queries.mixed(odd_docs)
    assert Counter((r.doc_id, r.topic, r.tokens, round(r.probability, 9)) for r in got.collect()) == Counter(chance)
    draw = lambda i: int(hashlib.md5(f"{'' if i is None else i}|{queries.MIX_SEED}".encode()).hexdigest()[:8], 16) / 2**32
    want = Counter(i for i, _, _, p in chance if draw(i) < p)
    assert Counter(i for i, _ in pairs(pipeline.mix(spark, odd_docs, folder))) == want


def test_packing_stage_on_odd_rows(spark, folder, odd_docs):
    rows = pairs(odd_docs)
    ids = list(zip(rows, encoded(rows)))
    got = pipeline.pack(spark, odd_docs, folder).collect()
    used, covered = Counter(), Counter()
    for r in got:
        used[r.sequence_id] += r.length
        covered[r.doc_id] += r.length
    want = Counter()
    for (i, _), x in ids:
        want[i] += len(x)
    assert covered == want and max(used.values()) <= 2048
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got)
    for (i, _), x in ids:
        for start in range(0, len(x), 2048):
            assert pieces[i, start, len(x[start : start + 2048]), crc(x[start : start + 2048])] > 0


def test_stages_on_an_empty_table(spark, folder, make):
    docs = make([]).select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = saved(stage(spark, docs, folder), "test-empty")
    assert docs.count() == 0


def test_ids_that_repeat_stay_apart(spark, make):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text")]
    got = pipeline.exact(spark, make(rows), "")
    assert Counter(pairs(got)) == Counter({(1, "a b c d e f g"): 1, (1, "quite another text"): 1})


def test_near_stage_removes_rows_not_ids(spark, make):
    words = [f"w{i}" for i in range(60)]
    first, close, other = " ".join(words), " ".join([*words[:-1], "x"]), "a text that nothing else is like at all"
    rows = [(1, first), (2, close), (2, other), (3, other + " y"), (4, "alone with its id"), (None, first), (7, "")]
    got = pipeline.near(spark, saved(make(rows), "test-near"), "")
    assert Counter(pairs(got)) == Counter([(1, first), (2, other), *rows[4:]])
    both = [(5, first), (5, close), (5, other)]
    got = pairs(pipeline.near(spark, saved(make(both), "test-near"), ""))
    assert len(got) == 2 and (5, other) in got


def test_row_keys_do_not_depend_on_splits(spark, make):
    """A table of several files, read in few and in many splits, has the same keys; other plans are written first."""
    from tidegauge.functions.common import work_folder
    from tidegauge.llm.common import with_row_key

    path = work_folder(spark, "row-keys-test")
    make([(i % 300, f"text {i}") for i in range(600)]).repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    keys = []
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            df = with_row_key(spark.read.parquet(path), pipeline.COLUMNS, "k")
            keys.append({r.text: r.k for r in df.collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert keys[0] == keys[1] and len(set(keys[0].values())) == 600
    df = with_row_key(spark.read.parquet(path).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in pipeline.COLUMNS[1:]]), pipeline.COLUMNS, "k")
    assert df.columns == [*pipeline.COLUMNS, "k"] and df.select("k").distinct().count() == 300
