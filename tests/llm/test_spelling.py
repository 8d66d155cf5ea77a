"""Spelling variants against plain Python that compares all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows, least=5, times=3, divisor=97):
    counts = Counter()
    for i, t in rows:
        for run in RUN.findall(t or ""):
            run = run.translate(UPPER)
            x = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if x % divisor == 0:
                run = run[: x % len(run)] + run[x % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= times}


def brute(rows, **options):
    counts = counted(rows, **options)
    form, many = {}, {}
    for w, n in counts.items():
        others = [v for v in counts if near(v, w)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        many[w] = len(others)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, many[w], counts.get(form[w])))
    return sorted(out)


def got(df, **options):
    return sorted(map(tuple, spelling.variants(df, **options).collect()))


@pytest.fixture(params=[1, 8, 40])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("aliases", [0, 100_000])
def test_dense_words(spark, make, partitions, aliases, monkeypatch):
    """Few letters, so that words have many neighbours, runs of equal letters and shared prefixes over partitions."""
    monkeypatch.setattr(spelling, "ALIAS_ROWS", aliases)
    rng = random.Random(partitions)
    words = ["".join(rng.choices("abé", k=rng.choice([4, 5, 6, 7]))) for _ in range(150)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 151), k=60))) for i in range(60)]
    assert got(make(rows)) == brute(rows)


def test_changed_runs(make):
    """Every third run loses a letter; a chain of forms is followed to its end."""
    rng = random.Random(2)
    words = ["abcdefgh", "abcdefgx", "Ünïcödé", "straße", "éééééé", "zzzzzzz"]
    rows = [(rng.choice([None, *range(50)]), " ".join(rng.choices(words, weights=[64, 16, 8, 4, 2, 1], k=20))) for _ in range(80)]
    found = got(make(rows), divisor=3)
    assert found == brute(rows, divisor=3)
    assert any(form is not None and root != form for _, form, root, *_ in found)


def test_odd_rows(make, odd_rows):
    assert got(make(odd_rows * 3)) == brute(odd_rows * 3)


def test_very_long_words(make):
    long = "".join(random.Random(3).choices("abcdefghij", k=30_000))
    texts = [long, long, long, long[:-1], long[:-1], long[:-1], "x" + long[1:], "x" + long[1:], "x" + long[1:]] + [long] * 4
    rows = [(i, t) for i, t in enumerate(texts)]
    assert got(make(rows), divisor=10**9) == brute(rows, divisor=10**9)


def test_ties_and_empty_tables(make):
    rows = [(i, "baker maker taker") for i in range(3)] + [(9, "bakers " * 6 + "aaker " * 6)] * 2
    assert got(make(rows), divisor=10**9) == brute(rows, divisor=10**9)
    assert got(make([])) == [] and got(make([(1, None), (2, "ab 12 cd")])) == []


def test_joined_crc():
    rng = random.Random(4)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 2, 3, 5, 8, 100, 1000]))) for _ in range(60)]
    a, b = (np.array([zlib.crc32(p[i]) for p in pairs], np.uint32) for i in (0, 1))
    size = np.array([len(p[1]) for p in pairs])
    assert spelling.joined_crc(a, b, size).tolist() == [zlib.crc32(x + y) for x, y in pairs]


def test_near_words_come_once(spark):
    """Left out of a run of equal letters, a letter counts once."""
    words = spark.createDataFrame([("aaabbb", 3), ("aabbb", 9), ("aaabb", 9), ("aaaabbb", 4)], "word string, n long")
    numbered, pairs = spelling.pair_dictionary(words)
    found = numbered.join(spelling.near_words(pairs), "id").select("word", "n_near", "best.n").collect()
    assert {r.word: (r.n_near, r.n) for r in found} == {
        "aaabbb": (3, 9), "aabbb": (2, 9), "aaabb": (2, 9), "aaaabbb": (1, 3)}


def test_pairs_are_integers(spark):
    words = spark.createDataFrame([("abcde", 3), ("abxde", 3)], "word string, n long")
    _, pairs = spelling.pair_dictionary(words)
    assert dict(pairs.dtypes) == {"ahead": "bigint", "behind": "bigint", "id": "bigint", "n": "bigint", "skip": "boolean", "last": "boolean"}
    shared = pairs.where("skip").groupBy("ahead", "behind").agg(F.count("*").alias("n")).where("n > 1")
    assert shared.count() == 1
