"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

The strings to find are all windows of ``width`` words of the items; an item of fewer words
is one window as a whole. A symbol is a word, so nothing matches inside of one.

1. Items are cut into pieces of ``PIECE_WORDS`` windows, which are dealt to parts of about
   ``part_words`` words. A task numbers the words of its part and builds, for each length of
   window, the tables of the search and writes them to a file in the shared work folder.
2. Documents are searched in Arrow batches, part after part, with one part in memory. The
   words of a batch become numbers of the part's words (0: not in it), which are exact, with
   a 0 between documents. At the end of a window the block of its last two words is looked
   up: the shift table tells how many words further the next window may end, as no window
   has that block any later. Where the shift is 0, the bucket of the block's hash and the
   hash of the words before it select the strings to test, and the words are then compared.
   A batch is read in strips, all of which take a step at a time.

Nothing is shuffled but the items, and the driver sees one file name a part.

Definitions. A null text has no words. Items are told apart by ``item_id``; rows with one
id are one item with the windows of all, and a null id is written as the empty text. Every
row of ``docs`` gives one row, repeated ones too. Extra columns are ignored. An empty table
of items hits nothing; an empty table of documents gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder
from tidegauge.llm.common import U64, by_value, mix64, rewritten, saved, slices, words_of
from tidegauge.llm.records import opened

WIDTH, BLOCK = 10, 2
PIECE_WORDS, PART_WORDS = 1_000, 500_000
STRIP = 512
SLICE_BYTES = 16_000_000

# Letters A-Z in lower case, digits, a-z and all beyond ASCII stay, the rest parts words.
_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and a space for each character that parts words."""
    return rewritten(texts, lambda data: data.to_pybytes().translate(_KEPT))


@dataclass
class Tables:
    """The search for all windows of one length; ``words`` has a row for each different one."""

    length: int
    bits: int
    words: np.ndarray
    shift: np.ndarray  # by hash of a block
    first: np.ndarray  # first window of each bucket, by hash of the last block
    front: np.ndarray  # hash of the words before the last block, ascending in a bucket
    owners: np.ndarray  # items of the windows, those of window w from place[w] on
    place: np.ndarray


def _hash(words: np.ndarray, ends: np.ndarray, n: int, skip: int = 0) -> np.ndarray:
    """Hash of the ``n`` words that end ``skip`` before each of ``ends``."""
    out = np.full(len(ends), n, U64)
    for i in range(n):
        out = mix64(out + words[ends - skip - n + 1 + i].astype(U64) * U64(0x9E3779B97F4A7C15))
    return out


def build(sequences: list[np.ndarray], owners: np.ndarray, length: int) -> Tables:
    """Tables for the windows of ``length`` words of numbered pieces."""
    block = min(BLOCK, length)
    counts = np.array([len(s) - length + 1 for s in sequences])
    view = np.concatenate([np.lib.stride_tricks.sliding_window_view(s, length) for s in sequences])
    words, which = np.unique(view, axis=0, return_inverse=True)
    pairs = np.unique(np.stack([which.ravel(), np.repeat(owners, counts)]), axis=1)
    # The pieces have no more different blocks than words: an eighth of the shift table is used at most.
    bits = int(np.ceil(np.log2(8 * sum(map(len, sequences)) + 2)))
    flat, ends = words.ravel(), np.arange(len(words)) * length + length - 1
    shift = np.full(1 << bits, length - block + 1, np.int16)
    for back in range(length - block, -1, -1):
        at = (_hash(flat, ends - back, block) >> U64(64 - bits)).astype(np.int64)
        shift[at] = np.minimum(shift[at], back)
    bucket = (_hash(flat, ends, block) >> U64(64 - bits)).astype(np.int64)
    front = _hash(flat, ends, length - block, block)
    order = np.lexsort((front, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    owner_order = np.argsort(rank[pairs[0]], kind="stable")
    place = np.concatenate([[0], np.cumsum(np.bincount(rank[pairs[0]], minlength=len(words)))])
    first = np.searchsorted(bucket[order], np.arange((1 << bits) + 1)).astype(np.int32)
    return Tables(length, bits, words[order], shift, first, front[order], pairs[1][owner_order], place)


def search(tables: Tables, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the last word, window) of every occurrence in a sequence of word numbers."""
    length, block = tables.length, min(BLOCK, tables.length)
    at = np.arange(0, len(words), STRIP)
    stop = np.minimum(at + STRIP, len(words))
    at = np.maximum(at, length - 1)
    ends = []
    while len(at):
        live = at < stop
        at, stop = at[live], stop[live]
        step = tables.shift[(_hash(words, at, block) >> U64(64 - tables.bits)).astype(np.int64)]
        ends.append(at[step == 0])
        at = at + np.maximum(step, 1)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    bucket = (_hash(words, end, block) >> U64(64 - tables.bits)).astype(np.int64)
    front = _hash(words, end, length - block, block)
    found_end, found = [], []
    test, last = tables.first[bucket], tables.first[bucket + 1]
    # The windows of a bucket ascend by the hash of their front; halve until the first that is not below.
    low, high = test.copy(), last.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        below = open_ & (tables.front[np.minimum(middle, len(tables.front) - 1)] < front)
        low, high = np.where(below, middle + 1, low), np.where(open_ & ~below, middle, high)
    test = low
    while len(end):
        live = test < last
        live[live] = tables.front[test[live]] == front[live]
        end, test, last, front = end[live], test[live], last[live], front[live]
        same = (words[end[:, None] + np.arange(-length + 1, 1)] == tables.words[test]).all(axis=1)
        found_end.append(end[same])
        found.append(test[same])
        test = test + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_end), np.concatenate(found)


def pieces(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``item``, ``words`` (at most ``PIECE_WORDS`` windows): different rows only, long items are cut."""
    rows = items.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").alias("text")
    ).where(F.col("text").isNotNull()).distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                codes, distinct, bounds = words_of(folded(batch.column(1)))
                own, out = [], []
                for item, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                    for start in range(a, max(a + 1, b - width + 1) if b > a else a, PIECE_WORDS):
                        own.append(item)
                        out.append(distinct.take(pa.array(codes[start : min(b, start + PIECE_WORDS + width - 1)])))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                values = pa.concat_arrays(out) if out else pa.array([], pa.large_string())
                lists = pa.ListArray.from_arrays(pa.array(offsets), values.cast(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), lists], names=["item", "words"])

    return rows.mapInArrow(cut, "item string, words array<string>")


def parts(items: DataFrame, width: int = WIDTH, part_words: int = PART_WORDS, id_col: str = "item_id",
          text_col: str = "text") -> list[str]:
    """Files of the search tables of all parts; their number is that of the items' words by ``part_words``."""
    cut = saved(pieces(items, width, id_col, text_col).distinct(), "benchmark-pieces")
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    number = -(-total // part_words)
    if not number:
        return []
    folder = work_folder(items.sparkSession, "benchmark-tables")

    def write(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(group["item"]))
        owner = pd.Index(names).get_indexer(group["item"])
        flat = pa.array(np.concatenate(group["words"].to_numpy()), pa.string()).dictionary_encode()
        numbers = np.asarray(flat.indices, np.int32) + 1
        sizes = group["words"].map(len).to_numpy()
        sequences = np.split(numbers, np.cumsum(sizes)[:-1])
        length = np.minimum(sizes, width)
        tables = [
            build([sequences[i] for i in np.flatnonzero(length == n)], owner[length == n], int(n))
            for n in np.unique(length)
        ]
        name = f"{folder}/{uuid.uuid4().hex}.tables"
        with opened(name, write=True) as out:
            out.write(pickle.dumps((flat.dictionary, names, [vars(t) for t in tables])))
        return pd.DataFrame({"file": [name]})

    dealt = cut.withColumn("part", F.pmod(F.xxhash64("item", "words"), F.lit(number)))
    return [r.file for r in saved(dealt.groupBy("part").applyInPandas(write, "file string"), "benchmark-parts").collect()]


def _loaded(file: str) -> tuple[pa.Array, list[str], list[Tables]]:
    with opened(file) as stream:
        vocabulary, names, tables = pickle.loads(stream.read())
    return vocabulary, names, [Tables(**t) for t in tables]


def find(docs: DataFrame, items: DataFrame, width: int = WIDTH, part_words: int = PART_WORDS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row as ``doc_id``, ``n_words``, ``hits`` (stretches of words, ``last`` exclusive) and ``items`` (sorted ids)."""
    files = parts(items, width, part_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple] = {}
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                codes, distinct, bounds = words_of(folded(batch.column(1)))
                doc = np.repeat(np.arange(len(batch)), np.diff(bounds))
                place = np.arange(len(codes)) + doc  # a 0 stands between documents
                hit = np.zeros(len(codes) + len(batch) + 1, np.int32)
                own: list[set[str]] = [set() for _ in range(len(batch))]
                for file in files:
                    if file not in kept:
                        kept = {file: _loaded(file)}
                    vocabulary, names, every = kept[file]
                    known = pc.index_in(distinct, value_set=vocabulary.cast(distinct.type))
                    words = np.zeros(len(codes) + len(batch), np.int32)
                    words[place] = (np.asarray(pc.fill_null(known, -1), np.int32) + 1)[codes]
                    for tables in every:
                        end, window = search(tables, words)
                        np.add.at(hit, end - tables.length + 1, 1)
                        np.add.at(hit, end + 1, -1)
                        where = doc[np.searchsorted(place, end)] if len(end) else end
                        for d, w in np.unique(np.stack([where, window]), axis=1).T:
                            own[d].update(names[o] for o in tables.owners[tables.place[w] : tables.place[w + 1]])
                inside = np.concatenate([[0], np.cumsum(hit)[place] > 0, [0]]).astype(np.int8)
                new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
                first = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | new))
                ended = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | np.append(new[1:], True)[: len(doc)])) + 1
                stretches = pa.StructArray.from_arrays(
                    [pa.array(first - bounds[doc[first]]), pa.array(ended - bounds[doc[first]])], names=["first", "last"])
                offsets = np.searchsorted(doc[first], np.arange(len(batch) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(offsets), stretches),
                        pa.array([sorted(x) for x in own], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "hits", "items"],
                )

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(
        run, "doc_id long, n_words long, hits array<struct<first: long, last: long>>, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` of what ``find`` returns."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


by_value(__name__)
