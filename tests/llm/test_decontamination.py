"""Benchmark passages against plain Python that compares every window with every place."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidegauge.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
ITEMS = "item_id long, text string, id int, words string, row int"


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(rows, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), width)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        w, hit, own = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    own |= found
                    hit |= set(range(i, i + n))
        ids = hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(own), ids, bool(hit)))
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], ITEMS)


def digests(spark, make, rows, items, **options):
    return sorted(map(tuple, D.digest(D.find(make(rows), benchmark(spark, items), **options)).collect()), key=str)


ODD_ITEMS = [
    (1, "One, TWO three! four five six"), (2, None), (3, ""), (4, "..."), (None, "alpha beta"), (5, "SHORT"),
    (5, "other; text"), (6, "short"), (10, " ".join(f"w{i % 977}x{i % 1013}" for i in range(500, 3700))),
    (10, " ".join(f"w{i % 977}x{i % 1013}" for i in range(500, 3700))), (11, "Ünï cödé 日本"),
]


@pytest.mark.parametrize("part_words", [500_000, 700])
def test_odd_rows(spark, make, odd_rows, part_words):
    assert digests(spark, make, odd_rows, ODD_ITEMS, part_words=part_words) == brute(odd_rows, ODD_ITEMS)


@pytest.mark.parametrize("part_words", [500_000, 40])
def test_few_words_that_repeat(spark, make, part_words):
    """Items share windows and blocks; windows lie across strips, at both ends of texts, and overlap."""
    rng = random.Random(5)
    items = [(rng.randint(0, 9), " ".join(rng.choices("abc", k=rng.choice([1, 2, 3, 9, 10, 11, 25])))) for _ in range(12)]
    rows = [(i, " ".join(rng.choices("abcd", weights=[5, 5, 5, 1], k=rng.choice([0, 1, 9, 10, 40, 1500])))) for i in range(30)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(items)]
    items = [(i, t) for i, t in items if len(t) > 7]
    assert digests(spark, make, rows, items, part_words=part_words) == brute(rows, items)


def test_narrow_windows(spark, make):
    rows = [(1, "a b c d"), (2, "b"), (3, "c d a b")]
    for width in (1, 2, 3):
        items = [(1, "a b x"), (2, "c d")]
        assert digests(spark, make, rows, items, width=width) == brute(rows, items, width)


def test_stretches_and_items(spark, make):
    rows = [(1, "x one two THREE y, one two three one two three"), (2, "three one")]
    found = {r.doc_id: r for r in D.find(make(rows), benchmark(spark, [(7, "one two three")])).collect()}
    assert [tuple(h) for h in found[1].hits] == [(1, 4), (5, 11)] and found[1].items == ["7"]
    assert found[2].hits == [] and found[2].items == []


def test_empty_tables(spark, make):
    assert digests(spark, make, [], [(1, "a b")]) == []
    none = hashlib.sha256(b"").hexdigest()
    assert digests(spark, make, [(1, "a b"), (2, None)], []) == [(1, 2, 0, 0, none, False), (2, 0, 0, 0, none, False)]
    assert digests(spark, make, [(1, "a b")], [(1, None), (2, " ! ")]) == [(1, 2, 0, 0, none, False)]


def test_long_items_are_cut(spark):
    text = " ".join(f"w{i}" for i in range(5_000))
    cut = D.pieces(benchmark(spark, [(1, text)]), 10, "item_id", "text").collect()
    assert max(len(r.words) for r in cut) == D.PIECE_WORDS + 9
    windows = {tuple(r.words[i : i + 10]) for r in cut for i in range(len(r.words) - 9)}
    assert len(windows) == 4_991


def test_shifts_skip_words():
    """A text without any block of the items is read about a ninth as often as it has words."""
    tables = D.build([np.arange(1, 31, dtype=np.int32)], np.array([0]), 10)
    assert tables.shift.max() == 9
    end, window = D.search(tables, np.concatenate([np.zeros(700, np.int32), np.arange(1, 31, dtype=np.int32)]))
    assert sorted(end) == list(range(709, 730)) and len(set(window.tolist())) == 21


def test_folded_slices():
    texts = pa.array(["A-b", None, "Éa9"]).slice(1)
    assert D.folded(texts).to_pylist() == ["", "Éa9"]
