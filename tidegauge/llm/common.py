"""Shared pieces: reading and saving tables, splitting texts into words in Arrow, hashing."""

from __future__ import annotations

import ctypes
import gc
import sys
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.common import work_folder

U64 = np.uint64
RELEASE_SECONDS = 3.0
_released = [0.0]
#: Files that are numbered by a broadcast.
FEW_FILES = 20_000
ODD = 0x9E3779B97F4A7C15
ODD_INVERSE = pow(ODD, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back: lineage ends there.

    What the job has left behind is given back, though not more than once in ``RELEASE_SECONDS``.
    """
    path = work_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    if time.monotonic() - _released[0] > RELEASE_SECONDS:
        release(df)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_key(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` and a number for each row that is the same whenever the table is read again.

    Rows of Parquet files are numbered by their file and their place in it, which does not
    depend on how files are cut into splits. Of another plan the rows are written first.
    """
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    except AnalysisException:
        return saved(docs.select(*columns).withColumn(name, F.monotonically_increasing_id()), "row-keys")
    # A row for each file.
    files = placed.select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file")).cast("long"))
    files = saved(files, "files")
    files = F.broadcast(files) if files.limit(FEW_FILES + 1).count() <= FEW_FILES else files
    return placed.join(files, "_file").withColumn(name, F.shiftleft("_no", 36) + F.col("_at")).drop("_file", "_at", "_no")


def release(df: DataFrame) -> None:
    """Give back the shuffle files of the jobs that are over, and the driver's memory of them.

    Spark deletes the files once the driver's JVM has collected what stood for them, which a
    long job with a large heap may not do before the disks are full.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    trimmed(df.sparkSession)
    _released[0] = time.monotonic()


def trimmed(spark: SparkSession) -> str | None:
    """Let the driver's JVM return the native memory that it has freed, as ``jcmd System.trim_native_heap`` does.

    The C library keeps what threads and compilers have freed, in a pool for each of many
    threads, so a driver of many small jobs grows by more than its heap. Null: this JVM has
    no such command.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, *values):
        out = array(kind, len(values))
        for i, value in enumerate(values):
            out[i] = value
        return out

    try:
        # The server's own class is not open to calls, its interface is.
        kind, name = jvm.java.lang.Class, jvm.java.lang.Class.forName
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        invoke = name("javax.management.MBeanServer").getMethod("invoke", filled(kind, *map(name, names)))
        none = filled(jvm.java.lang.Object), filled(jvm.java.lang.String)
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return invoke.invoke(server, filled(jvm.java.lang.Object, bean, "systemTrimNativeHeap", *none))
    except Py4JError:
        return None


def giving_back(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function, after which the Python worker returns what it has freed: it idles while others work."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, takes_part: Column) -> DataFrame:
    """Left join of rows to the group of their ``keys``; ``size`` is a group's number of rows.

    Groups with more than a thousandth of all rows number less than a thousand and are
    broadcast; the other rows meet their group by an exchange. Rows that take no part stay
    without a group. ``groups`` must be a saved table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    large = F.col(size) * 1000 > total
    hot = F.broadcast(groups.where(large))
    part = rows.where(takes_part)
    joined = part.join(hot, keys).unionByName(
        part.join(hot, keys, "left_anti").join(groups.where(~large), keys, "left")
    )
    rest = rows.where(~F.coalesce(takes_part, F.lit(False)))
    return joined.unionByName(rest, allowMissingColumns=True)


def own_name(columns: list[str], wanted: str) -> str:
    """``wanted``, or a longer form of it, that clashes with none of ``columns`` (case does not count)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def slices(batch: pa.RecordBatch, text: int, limit: int):
    """Cut a batch so that each piece holds about ``limit`` bytes of text and at least one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    part = np.cumsum(sizes) // limit
    starts = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else []
    for a, b in zip(starts, [*starts[1:], len(part)]):
        yield batch.slice(int(a), int(b - a))


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (code of each word, distinct words, first word of each text).

    The last array has one more entry than there are texts. A null text has no words.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if empty >= 0:
        keep = codes != empty
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return codes, coded.dictionary, bounds


def rewritten(texts: pa.Array, change) -> pa.Array:
    """The texts after ``change`` of all their bytes, which keeps the number of bytes; a null text is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return texts
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    part = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.Array.from_buffers(
        pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(change(part))])


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads their bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word, the same in every process."""
    from pandas.util import hash_array

    values = np.asarray(words.to_pylist(), dtype=object)
    return hash_array(values, categorize=False) if len(values) else np.zeros(0, U64)


def hash_runs(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` consecutive words inside a text, and the place of its first word.

    The runs come in order; a text with fewer than ``n`` words has none. Runs of different
    lengths have unrelated hashes.
    """
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    # Prefix sums of word * odd**place; the inverse power takes the place out again.
    power = np.cumprod(np.concatenate([np.ones(1, U64), np.full(len(hashes) - 1, ODD, U64)]), dtype=U64)
    inverse = np.cumprod(np.concatenate([np.ones(1, U64), np.full(m - 1, ODD_INVERSE, U64)]), dtype=U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * power, dtype=U64)])
    counts = np.diff(bounds)
    left = np.repeat(bounds[1:], counts)[:m] - np.arange(m)
    at = np.flatnonzero(left >= n)
    return mix64((sums[at + n] - sums[at]) * inverse[at] + U64(n)), at


def by_value(name: str) -> None:
    """Pickle the functions of a module by value, so that executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)
