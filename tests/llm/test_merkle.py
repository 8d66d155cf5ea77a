"""The manifest against a plain tree, proofs against recomputation."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import merkle
from tidegauge.llm.numbering import numbered

UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, fan):
    """(root, siblings of each leaf as (before, after) by level)."""
    level, owner, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, at in enumerate(owner):
            run, i = runs[at // fan], at % fan
            proofs[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
        owner = [at // fan for at in owner]
        level = [h("".join(run)) for run in runs]
    return level[0], proofs


def brute(rows, fan=16):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, found = [], []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, proofs = tree([leaf(r) for r in own], fan)
        subroots.append(sub)
        found.append((own, proofs))
    root, above = tree(subroots, fan) if subroots else ("", [])
    out = []
    for (own, proofs), sub, up in zip(found, subroots, above):
        for row, proof in zip(own, proofs):
            proof = proof + up
            i, *rest, text = row
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None
            now = leaf((i, *rest, text.translate(UPPER) if tampered else text))
            for before, after in proof:
                now = h(before + now + after)
            out.append((i, leaf(row), sub, root, h("".join(a + b for a, b in proof)), now, now == root))
    return Counter(out)


def got(spark, rows, fan=16, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "place", "size", "digest", "number")})
    return Counter(map(tuple, merkle.digest(merkle.manifest(df.repartition(3), fan=fan, **options)).collect()))


def series(n, source, start=0):
    return [(start + i, source, "en", i, f"Text {i % 7} of Ä") for i in range(n)]


@pytest.mark.parametrize("fan", [2, 3, 16])
@pytest.mark.parametrize("few", [0, 4_000])
def test_trees_of_many_sizes(spark, monkeypatch, fan, few):
    """Lone leaves, whole and partly filled runs, one and many sources; joins of both kinds."""
    monkeypatch.setattr(merkle, "FEW_NODES", few)
    rows = series(70, "hot") + series(16, "a", 1000) + series(17, None, 2000) + series(1, "é", 3000) + series(1, "", 4000)
    random.Random(1).shuffle(rows)
    assert got(spark, rows, fan) == brute(rows, fan)


def test_many_sources(spark):
    rows = [(i, f"s{i % 40}", None, None, "ABC") for i in range(90)]
    result = got(spark, rows)
    assert result == brute(rows) and {r[-1] for r in result} == {True, False}


def test_odd_rows(spark, odd_rows):
    rows = [(i, s, None, 3, t) for i, t in odd_rows for s in ("x", None)]
    assert got(spark, rows) == brute(rows)


def test_rows_that_repeat(spark):
    rows = [(1, "s", "en", 1, "A")] * 20 + [(None, None, None, None, None)] * 5 + [(1, "s", "en", 1, "B")]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(None, None, None, None, None)], series(5, "only")])
def test_small_tables(spark, rows):
    assert got(spark, rows) == brute(rows)


def test_numbers_of_equal_rows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.lit("x").alias("_tie")).repartition(4)
    rows = numbered(df, ["k"], "number").collect()
    assert sorted(r.number for r in rows) == list(range(500))
    assert [r.k for r in sorted(rows, key=lambda r: r.number)] == sorted(r.k for r in rows)
    assert rows[0].asDict().keys() == {"k", "_tie", "number"}
