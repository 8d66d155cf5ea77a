"""Token ids in files of length-delimited binary records, with a separate offset index.

Format. A file is a row of frames; a frame is

    length   uint64   bytes of the record
    check    uint32   masked CRC-32 of the eight bytes before
    record            has_id uint8, id int64, width uint8 (2 or 4), count uint32, ids
    check    uint32   masked CRC-32 of the record

all little-endian. The mask rotates the checksum right by 15 bits and adds a constant, so
that the checksum of data which holds checksums is sound. The index is a Parquet table
with ``shard``, ``file``, ``offset``, ``bytes``, ``doc_id`` and ``n_tokens`` per record.

Files hold ascending ids: a file of a smaller shard number comes before those of greater
ones. A task writes a shard for about every ``FILE_BYTES`` of records, under a name of its
own attempt; only files that the index names exist for readers, so attempts that failed or
ran twice leave nothing behind that is read. Each file is read by a task of its own.

Definitions. A null or empty text has the end id only. Rows with equal ids are ordered by a
hash of the text, null ids come first; rows alike in both are spread over tasks by where they
come from. Extra columns are ignored. An empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder
from tidegauge.llm.common import by_value, saved, slices
from tidegauge.llm.tokens import SLICE_BYTES, encoder

# Fixed value: the constant added to a rotated checksum.
MASK = 0xA282EAD8

HEAD, RECORD = "<QI", "<BqBI"
HEAD_BYTES = struct.calcsize(HEAD)

FILE_BYTES = 128_000_000
#: Rows of one result batch, and bytes that a reader fetches at a time.
ROWS_OUT, FETCHED = 10_000, 1 << 20

_INDEX = "shard long, file string, offset long, bytes long, doc_id long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if len(ids) == 0 or ids.max() < 1 << 16 else 4
    body = struct.pack(RECORD, doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(body))
    return length + struct.pack("<I", masked(length)) + body + struct.pack("<I", masked(body))


def next_record(stream) -> tuple[int | None, np.ndarray] | None:
    """The record at the stream's place; None at the end. Damage raises an error."""
    head = stream.read(HEAD_BYTES)
    if not head:
        return None
    if len(head) < HEAD_BYTES or masked(head[:8]) != struct.unpack(HEAD, head)[1]:
        raise ValueError("damaged length of a record")
    body = stream.read(struct.unpack(HEAD, head)[0])
    check = stream.read(4)
    if len(check) < 4 or struct.unpack("<I", check)[0] != masked(body):
        raise ValueError("damaged record")
    has_id, doc_id, width, count = struct.unpack_from(RECORD, body)
    ids = np.frombuffer(body, f"<u{width}", count, struct.calcsize(RECORD)).astype(np.uint32)
    return (doc_id if has_id else None), ids


def opened(path: str, write: bool = False, forward: bool = False):
    """A stream of any file system that pyarrow knows; plain paths and ``file:/`` are local.

    One that is only read ``forward`` is fetched in large parts.
    """
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_stream(inner, buffer_size=FETCHED) if forward else system.open_input_file(inner)


def write_records(docs: DataFrame, tokenizer: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text",
                  folder: str | None = None) -> DataFrame:
    """Encode all texts, write them in ascending id order, return the index.

    ``folder`` must be visible to all executors; by default it is in the shared work folder.
    """
    folder = folder or work_folder(docs.sparkSession, "records")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    order = ["id", "key", "tie"]
    rows = rows.withColumns({"key": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, at, encode = TaskContext.get().partitionId() << 24, None, 0, None
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                encode = encode or encoder(tokenizer, end)
                ids, cuts = encode(batch.column(1))
                doc_ids = batch.column(0).to_pylist()
                frames = [frame(d, ids[a:b]) for d, a, b in zip(doc_ids, cuts, cuts[1:])]
                sizes = np.array([len(f) for f in frames], np.int64)
                counts, first = np.diff(cuts), 0
                while first < len(frames):
                    if out is None:
                        name, at = f"{folder}/{shard:015d}-{uuid.uuid4().hex}.records", 0
                        out = opened(name, write=True)
                    # At least one record, and no more than reach the size of a file.
                    last = first + 1 + int(np.searchsorted(np.cumsum(sizes[first:]), FILE_BYTES - at))
                    last = min(last, len(frames))
                    out.write(b"".join(frames[first:last]))
                    n, own = last - first, sizes[first:last]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, shard, np.int64)), pa.array([name] * n, pa.string()),
                            pa.array(at + np.cumsum(own) - own), pa.array(own),
                            pa.array(doc_ids[first:last], pa.int64()), pa.array(counts[first:last]),
                        ],
                        names=["shard", "file", "offset", "bytes", "doc_id", "n_tokens"],
                    )
                    first, at = last, at + int(own.sum())
                    if at >= FILE_BYTES:
                        out.close()
                        out, shard = None, shard + 1
        if out:
            out.close()

    return saved(ordered.mapInArrow(write, _INDEX), "record-index")


def read_files(index: DataFrame) -> DataFrame:
    """All records of the indexed files, read from front to end: id, first id's place, count, checksum of the ids."""
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("total"))
    # A row for each file.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    files = saved(
        files.select("shard", "file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start")), "record-files")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = []
                with opened(path, forward=True) as stream:
                    while (record := next_record(stream)) is not None:
                        doc_id, ids = record
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == ROWS_OUT:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    # A number of partitions that is given is not merged, however small the rows are.
    return files.repartitionByRange(max(1, files.count()), "shard").mapInArrow(read, _READ)


def read_at(index: DataFrame) -> DataFrame:
    """Single records by their index rows, in any order: ``doc_id`` and ``ids``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, streams = [], {}
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path not in streams:
                    for old in streams.values():
                        old.close()
                    streams = {path: opened(path)}
                streams[path].seek(offset)
                rows.append(next_record(streams[path]))
            for old in streams.values():
                old.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1].astype(np.int64) for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "ids"],
            )

    return index.select("file", "offset").mapInArrow(read, "doc_id long, ids array<long>")


by_value(__name__)
