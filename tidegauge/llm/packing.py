"""Packing token sequences by best-fit decreasing.

Documents longer than a sequence are first cut into full windows. The pieces are dealt to
groups of bounded size by a hash; in each group they are placed in order of decreasing
length, each into the open sequence with the least room that suffices. A segment tree over
the remaining room finds it. As a group holds tens of thousands of pieces, what grouping
costs against packing all pieces at once is at most one part-filled sequence per length
class and group.

Definitions. A null or empty text has the end id only. Every id lies in exactly one piece.
Repeated rows are packed each. Equal lengths are placed in order of id and place, so the
result does not depend on how rows arrive; only pieces that are alike in id, place, length
and checksum, and so many that they would fill a tenth of a group, are dealt by their
number, which spreads them. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import by_value, giving_back, saved, slices
from tidegauge.llm.tokens import SLICE_BYTES, encoder

ROOM = 2048
GROUP_PIECES = 50_000

_PIECE = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = 1, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encoded documents cut into windows of ``room`` ids; ``piece`` numbers them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, encode = TaskContext.get().partitionId() << 36, None
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                encode = encode or encoder(tokenizer, end)
                ids, cuts = encode(batch.column(1))
                sizes = np.diff(cuts)
                windows = -(-sizes // room)
                doc = np.repeat(np.arange(len(sizes)), windows)
                order = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
                start = order * room
                length = np.minimum(room, sizes[doc] - start)
                first = cuts[:-1][doc] + start
                own = [ids[a : a + n] for a, n in zip(first, length)]
                columns = [
                    pa.array(number + np.arange(len(doc))), batch.column(0).take(pa.array(doc)), pa.array(start),
                    pa.array(length), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                    pa.array(sizes[doc]),
                ]
                if with_ids:
                    columns.append(pa.array([x.astype("<u4").tobytes() for x in own], pa.binary()))
                number += len(doc)
                names = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names[: len(columns)])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return texts.mapInArrow(giving_back(cut), _PIECE + ", ids binary" * with_ids)


class Rooms:
    """Open sequences by remaining room, with a segment tree over the rooms that occur."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(room + 1)]

    def _set(self, room: int, full: int) -> None:
        at = room + self.leaves
        while at and self.tree[at] != full:
            self.tree[at] = full
            at >>= 1
            full = self.tree[2 * at] | self.tree[2 * at + 1]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        if len(self.open[room]) == 1:
            self._set(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) of an open sequence with the least room of at least ``least``."""
        at = least + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        sequence = self.open[room].pop()
        if not self.open[room]:
            self._set(room, 0)
        return room, sequence


def best_fit(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; the lengths must be in decreasing order."""
    rooms, sequences, offsets, count = Rooms(room), [], [], 0
    for n in lengths.tolist():
        found = rooms.take(n)
        if found is None:
            found = (room, count)
            count += 1
        left, sequence = found
        sequences.append(sequence)
        offsets.append(room - left)
        if left > n:
            rooms.put(left - n, sequence)
    return np.array(sequences, np.int64), np.array(offsets, np.int64)


def layout(cut: DataFrame, room: int = ROOM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces; ``cut`` must give the same rows each time it is read."""
    groups = max(1, -(-cut.count() // group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "start", "ids_crc32", "piece"], ascending=[False] + [True] * 4, ignore_index=True
        )
        sequence, offset = best_fit(group["length"].to_numpy(), room)
        group["sequence_id"] = sequence * groups + int(group["group"].iloc[0])
        group["offset"] = offset
        return group.drop(columns="group")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    alike = ["doc_id", "start", "length", "ids_crc32"]
    # No more than ten per group, so they can be broadcast.
    often = cut.groupBy(*alike).agg(F.count("*").alias("times")).where(F.col("times") * 10 > group_pieces)
    often = F.broadcast(often.select(*[F.col(c).alias(f"often_{c}") for c in alike]))
    same = F.lit(True)
    for c in alike:
        same = same & F.col(c).eqNullSafe(F.col(f"often_{c}"))
    number = F.when(F.col("often_length").isNotNull(), F.col("piece"))
    dealt = cut.join(often, same, "left").withColumn("group", F.pmod(F.xxhash64(*alike, number), F.lit(groups)))
    dealt = dealt.drop(*[f"often_{c}" for c in alike])
    return dealt.groupBy("group").applyInPandas(pack, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Where each piece of each document goes."""
    cut = saved(pieces(docs, tokenizer, room, end, id_col, text_col), "pieces")
    return layout(cut, room).drop("piece")


def sequences(docs: DataFrame, tokenizer: str, room: int = ROOM, end: int = 1, pad: int = 0,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences: ``sequence_id``, ``used``, ``ids`` (padded to ``room`` with ``pad``)."""
    cut = saved(pieces(docs, tokenizer, room, end, id_col, text_col, with_ids=True), "pieces")
    places = layout(cut.drop("ids"), room).select("piece", "sequence_id", "offset")
    rows = cut.select("piece", "length", "ids").join(places, "piece")

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out = np.full(room, pad, np.int64)
        for offset, ids in zip(group["offset"], group["ids"]):
            own = np.frombuffer(ids, "<u4")
            out[offset : offset + len(own)] = own
        return pd.DataFrame({"sequence_id": [key[0]], "used": [group["length"].sum()], "ids": [out]})

    return rows.groupBy("sequence_id").applyInPandas(fill, "sequence_id long, used long, ids array<long>")


by_value(__name__)
