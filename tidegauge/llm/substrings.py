"""Removing passages that repeat across documents, with a count-min prefilter.

A window is ``width`` consecutive words of a document. Its anchor is the smallest hash
among the runs of ``gram`` words inside it; equal windows have equal anchors, so the number
of documents with an anchor is never below that of documents with one of its windows, and
neighbouring windows mostly share their anchor.

1. Every task adds the anchors of its documents to a count-min sketch, and the sketches of
   the tasks are merged block by block. What is kept of a cell is whether it was met at
   least twice. A sketch overestimates, so no repeated window is lost.
2. Windows whose anchor is estimated repeated go, in runs, to the task of their anchor,
   where they are grouped exactly by anchor and window hash (two independent 64-bit
   values). Of equal windows inside a slice of a task only those of the smallest id are
   sent, as the others are known to be repeats and go straight to the result; so a passage
   that very many documents share is sent once a slice. The windows of an anchor with more
   than ``HOT_WINDOWS`` of them, say of a passage shorter than a window in very many
   documents, are dealt by their own hash instead, after the smallest id of each window is
   found by a combining aggregate.
3. The removed stretches meet their documents by id and text.

The sketch has about four cells per expected anchor up to ``1 << MAX_BITS`` cells in each
of its rows (128 MB in all, which bounds what is broadcast). Beyond that size it lets more
windows through, at the cost of time, never of results.

Definitions. A null or empty text has no words. A word goes if a window that covers it also
starts in a document with a smaller id; windows are those of the input. Rows with equal
ids do not remove from each other. A row with a null id neither removes nor is removed
from. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import U64, by_value, hash_runs, hash_words, mix64, saved, slices, text_or_empty, words_of

WIDTH, GRAM = 50, 20
ROWS, BLOCK_BITS, MIN_BITS, MAX_BITS = 2, 18, 18, 29
FLUSH_ANCHORS = 4_000_000
SLICE_BYTES = 8_000_000
GROUP_WINDOWS = 500_000
HOT_WINDOWS = 50_000


def _least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` consecutive values."""
    span = 1
    while 2 * span <= n:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = n - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def windows(texts: pa.Array, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word in its text, hash, anchor) of every window, in order."""
    codes, distinct, bounds = words_of(texts)
    hashes = hash_words(distinct)[codes]
    window, at = hash_runs(hashes, bounds, width)
    if not len(at):
        return np.zeros(0, np.int64), at, window, window
    run, place = hash_runs(hashes, bounds, gram)
    every = np.full(len(hashes), np.iinfo(U64).max, U64)
    every[place] = run
    anchor = _least_of(every, width - gram + 1)[at]
    text = np.searchsorted(bounds, at, side="right") - 1
    return text, at - bounds[text], window, anchor


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix64(anchors + U64(row + 1)) >> U64(64 - bits)).astype(np.int64)


def sketch(docs: DataFrame, bits: int, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Merged sketch of (``id``, ``text``) rows: for each row a bit per cell, set if it was met twice."""
    block_bits = min(BLOCK_BITS, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            anchors = np.concatenate(held) if held else np.zeros(0, U64)
            held.clear()
            for row in range(ROWS):
                cell, times = np.unique(_cells(anchors, row, bits), return_counts=True)
                block = cell >> block_bits
                number, first = np.unique(block, return_index=True)
                ends = [*first[1:], len(cell)]
                packed = ((cell & ((1 << block_bits) - 1)) << 1 | (times > 1)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(number), row, np.int32)), pa.array(number.astype(np.int32)),
                        pa.array([packed[a:b].tobytes() for a, b in zip(first, ends)], pa.binary()),
                    ],
                    names=["row", "block", "cells"],
                )

        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                text, _, _, anchor = windows(batch.column(1), width, gram)
                # A document counts once for an anchor.
                order = np.lexsort((anchor, text)) if len(anchor) else np.zeros(0, np.int64)
                text, anchor = text[order], anchor[order]
                new = np.ones(len(anchor), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                held.append(anchor[new])
                if sum(map(len, held)) >= FLUSH_ANCHORS:
                    yield from flush()
        yield from flush()

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        once, twice = np.zeros(1 << block_bits, bool), np.zeros(1 << block_bits, bool)
        for cells in group["cells"]:
            own = np.frombuffer(cells, np.uint32)
            cell = own >> 1
            twice[cell] |= once[cell] | (own & 1).astype(bool)
            once[cell] = True
        return pd.DataFrame({"row": [key[0]], "block": [key[1]], "bits": [np.packbits(twice).tobytes()]})

    parts = docs.mapInArrow(count, "row int, block int, cells binary").groupBy("row", "block")
    out = np.zeros((ROWS, (1 << bits) // 8), np.uint8)
    size = (1 << block_bits) // 8
    # At most ROWS * 2**MAX_BITS bits reach the driver.
    for row, block, packed in parts.applyInPandas(merge, "row int, block int, bits binary").toLocalIterator():
        out[row, block * size : (block + 1) * size] = np.frombuffer(packed, np.uint8)
    return out


def estimated_repeated(seen: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    """Whether the sketch lets each anchor through."""
    out = np.ones(len(anchors), bool)
    for row in range(len(seen)):
        cell = _cells(anchors, row, bits)
        out &= (seen[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts; keys that count up by one are given less their index."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _least_id(ids: np.ndarray, anchor: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The smallest id among equal windows, for each window."""
    order = np.lexsort((ids, window, anchor))
    first = _starts(anchor[order], window[order])
    out = np.empty_like(ids)
    if len(order):
        out[order] = np.repeat(ids[order][first], np.diff([*first, len(order)]))
    return out


def repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Stretches of words to remove: ``id``, ``text_key``, ``first``, ``last`` (exclusive), by window runs.

    ``docs`` has ``id`` (long), ``text`` and ``text_key``.
    """
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Five letters a word, an anchor for every (width - gram + 2) / 2 words, four cells an anchor.
    bits = int(np.clip(np.ceil(np.log2(chars / 5 * 2 / (width - gram + 2) * 4 + 1)), MIN_BITS, MAX_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(sketch(docs, bits, width, gram))
    # A run that is known to repeat has neither anchor nor windows.
    schema = "id long, text_key long, first long, last long, anchor long, windows binary"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                text, place, window, anchor = windows(batch.column(1), width, gram)
                live = estimated_repeated(sent.value, anchor, bits) if len(anchor) else np.zeros(0, bool)
                text, place, window, anchor = text[live], place[live], window[live], anchor[live]
                if not len(text):
                    continue
                ids = np.asarray(batch.column(0), np.int64)[text]
                keys = np.asarray(batch.column(2), np.int64)[text]
                known = _least_id(ids, anchor, window) < ids
                # Runs of windows that follow each other in a text and are alike in all that matters.
                step = place - np.arange(len(place))
                cut = _starts(text, step, known, np.where(known, U64(0), anchor))
                ends = np.array([*cut[1:], len(text)])
                told = known[cut]
                code = window.view(np.int64).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[cut]), pa.array(keys[cut]), pa.array(place[cut]),
                        pa.array(place[ends - 1] + width), pa.array(anchor[cut].view(np.int64), mask=told),
                        pa.array([None if t else code[8 * a : 8 * b] for t, a, b in zip(told, cut, ends)], pa.binary()),
                    ],
                    names=["id", "text_key", "first", "last", "anchor", "windows"],
                )

    def resolve(rest: pd.DataFrame) -> pd.DataFrame:
        window = np.frombuffer(b"".join(rest["windows"]), U64)
        count = np.array([len(x) // 8 for x in rest["windows"]])
        run = np.repeat(np.arange(len(rest)), count)
        ids = rest["id"].to_numpy()[run]
        anchor = rest["anchor"].to_numpy().view(U64)[run]
        place = np.repeat(rest["first"].to_numpy() - np.cumsum(count) + count, count) + np.arange(len(run))
        hit = np.flatnonzero(_least_id(ids, anchor, window) < ids)
        cut = _starts(run[hit], hit - np.arange(len(hit)))
        ends = np.array([*cut[1:], len(hit)], np.int64)[: len(cut)]
        return pd.DataFrame({
            "id": ids[hit[cut]], "text_key": rest["text_key"].to_numpy()[run[hit[cut]]],
            "first": place[hit[cut]], "last": place[hit[ends - 1]] + width,
        })

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(4)
            count = np.asarray(pc.binary_length(codes), np.int64) // 8
            run = np.repeat(np.arange(len(count)), count)
            window = np.frombuffer(b"".join(codes.to_pylist()), np.int64)
            step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            ids, keys, first, anchor = (np.asarray(batch.column(i), np.int64)[run] for i in range(4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (anchor, window, ids, keys, first + step)],
                names=["anchor", "window", "id", "text_key", "first"],
            )

    runs = saved(docs.mapInArrow(find, schema), "window-runs")
    told = runs.where(F.col("anchor").isNull()).select("id", "text_key", "first", "last")
    rest = runs.where(F.col("anchor").isNotNull())
    of_run = F.col("last") - F.col("first") - width + 1
    windows_sent = rest.agg(F.sum(of_run)).first()[0] or 0
    groups = max(1, -(-windows_sent // GROUP_WINDOWS))
    often = rest.groupBy("anchor").agg(F.sum(of_run).alias("sent")).where(F.col("sent") > HOT_WINDOWS)
    # There are at most windows_sent / HOT_WINDOWS of these anchors.
    often = F.broadcast(saved(often.select("anchor"), "frequent-anchors"))
    dealt = rest.join(often, "anchor", "left_anti").withColumn("group", F.pmod(F.xxhash64("anchor"), F.lit(groups)))
    found = dealt.groupBy("group").applyInPandas(resolve, "id long, text_key long, first long, last long")
    spread = rest.join(often, "anchor").select("id", "text_key", "first", "anchor", "windows").mapInArrow(
        single, "anchor long, window long, id long, text_key long, first long")
    least = spread.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least = least.where(F.col("least") < F.col("most")).drop("most")
    hits = spread.join(least, ["anchor", "window"]).where(F.col("id") > F.col("least"))
    hits = hits.select("id", "text_key", "first", (F.col("first") + width).alias("last"))
    return told.unionByName(found).unionByName(hits)


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """Every row as ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space)."""
    docs = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(f"`{text_col}`").alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    found = repeats(docs.where(F.col("id").isNotNull()), width, gram)
    # A document's stretches number no more than its words.
    stretches = found.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("gone"))
    joined = docs.join(stretches, ["id", "text_key"], "left").select("id", "text", "gone")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                texts, counts, removed = [], [], []
                for text, gone in zip(batch.column(1), batch.column(2).to_pylist()):
                    words = text.as_py().encode().split()
                    counts.append(len(words))
                    if gone:
                        out = np.zeros(len(words) + 1, np.int64)
                        np.add.at(out, [g["first"] for g in gone], 1)
                        np.add.at(out, [g["last"] for g in gone], -1)
                        stay = np.cumsum(out)[:-1] == 0
                        words = [w for w, s in zip(words, stay.tolist()) if s]
                    removed.append(counts[-1] - len(words))
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return joined.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


by_value(__name__)
