"""Grouping spelling variants with a dictionary of pairs of trie nodes.

Words are numbered in sorted order. Their prefixes are the nodes of a trie, and those of the
reversed words the nodes of another; each node gets a number. A word is then found by the
pair (node of what is before a place, node of what is after it): a *split* pair for each
place between two letters, and a *skip* pair for each letter that is left out. Two words
with one skip pair differ in that letter only. A word with a skip pair that is another's
split pair has one letter more. Both are exact, as nodes stand for whole prefixes and
suffixes, and each pair of near words meets once: of a run of equal letters only the last
counts as left out.

1. Runs of letters are counted in Arrow batches. The CRC-32 of ``<id>:<run>`` is put together
   from those of the id and of the run, which is linear in the bits of the first.
2. Words in sorted order are cut by range. Along a partition a word shares with the one
   before it the nodes of their common prefix; the rest are new. Where a partition starts
   inside the trie of those before it, the shared nodes, of one word a partition, are renamed.
3. Pairs meet by an exchange on the two integers. Words with one skip pair differ in one
   letter, so there are no more of them than letters in the alphabet, and one word has the
   split pair. What a member needs of the others is a count and the best two, so no pairs
   of words are made.
4. Forms are followed by doubling.

Definitions. A null text has no words; a null id is written as the empty text. Rows that
repeat count each. Words have at least ``least`` letters and ``times`` occurrences; the form
of a word is the near word of largest count (ties: the smallest in code-point order) if that
is at least twice the word's. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import by_value, rewritten, saved, slices
from tidegauge.llm.components import join_labels

LEAST, TIMES, FACTOR, DIVISOR = 5, 3, 2, 97
SLICE_BYTES = 8_000_000
KEPT_WORDS = 400_000
#: Node and word numbers: the partition above, the place in it below.
PART = 1 << 40
ALIAS_ROWS = 100_000


def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z in lower case and a space for all but a-z and U+00C0 to U+00FF."""

    def change(data: pa.Buffer) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        upper = (raw >= 65) & (raw <= 90)
        # U+00C0 to U+00FF are the byte C3 and one after it.
        lead = raw == 0xC3
        kept = upper | ((raw >= 97) & (raw <= 122)) | lead
        kept[1:] |= lead[:-1]
        return np.where(kept, raw + (upper.astype(np.uint8) << np.uint8(5)), np.uint8(32))

    return rewritten(texts, change)


def _zeros_operator(length: int, cache: dict[int, np.ndarray]) -> np.ndarray:
    """What ``length`` zero bytes after a text do to its CRC-32: a table for each of its four bytes."""
    if length not in cache:
        byte = np.arange(256, dtype=np.uint32)
        cache.setdefault(0, np.stack([byte << np.uint32(8 * i) for i in range(4)]))
        if 1 not in cache:
            step = byte.copy()  # of the reversed polynomial, one zero bit after the other
            for _ in range(8):
                step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
            cache[1] = np.stack([step] + [byte << np.uint32(8 * i - 8) for i in range(1, 4)])
        half = _zeros_operator(length // 2, cache) if length > 1 else cache[length]
        if length > 1:
            both = _applied(half, half)
            cache[length] = _applied(cache[1], both) if length % 2 else both
    return cache[length]


def _applied(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros(crc.shape, np.uint32)
    for i in range(4):
        out ^= operator[i][(crc >> np.uint32(8 * i)) & np.uint32(255)]
    return out


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined byte strings from those of the two and the length of the second."""
    out, cache = second.copy(), {}
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        out[at] ^= _applied(_zeros_operator(int(n), cache), first[at])
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                times: int = TIMES, divisor: int = DIVISOR) -> DataFrame:
    """``word`` and ``n`` of all words: runs of letters, with one letter left out where ``divisor`` divides
    the CRC-32 of id and run."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                lists = pc.ascii_split_whitespace(letters_only(batch.column(1)))
                coded = lists.flatten().dictionary_encode()
                codes, runs = np.asarray(coded.indices, np.int64), coded.dictionary.to_pylist()
                raw = [r.encode() for r in runs]
                own = np.array([zlib.crc32(r) for r in raw], np.uint32)
                size = np.array([len(r) for r in raw], np.int64)
                ids = ["" if i is None else str(i) for i in batch.column(0).to_pylist()]
                of_id = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
                doc = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(lists), np.int64))
                h = joined_crc(of_id[doc], own[codes], size[codes]) if len(codes) else np.zeros(0, np.uint32)
                changed = h % np.uint32(divisor) == 0
                whole = np.bincount(codes[~changed], minlength=len(runs))
                for i in np.flatnonzero(whole):
                    if len(runs[i]) >= least:
                        held[runs[i]] += int(whole[i])
                for i, x in zip(codes[changed].tolist(), h[changed].tolist()):
                    if len(runs[i]) > least:
                        at = x % len(runs[i])
                        held[runs[i][:at] + runs[i][at + 1 :]] += 1
                if len(held) > KEPT_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counted = rows.where(F.col("text").isNotNull()).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _common(a: str, b: str) -> int:
    return len(commonprefix([a, b]))


def numbered_nodes(words: DataFrame, key: str, nodes: str) -> tuple[DataFrame, DataFrame]:
    """(``words`` in the order of ``key`` with ``place``, ascending in that order, and ``nodes``: a number
    for each of the key's prefixes; ``node`` and ``real`` of nodes that have a number of an earlier partition)."""
    fields = [f for f in words.schema if f.name != key]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    others = [f.name for f in fields]
    ordered = words.select(key, *others).repartitionByRange(key).sortWithinPartitions(key)
    ordered = ordered.withColumn("place", F.monotonically_increasing_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, new, before, path = TaskContext.get().partitionId() * PART, 0, "", []
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                shared = _common(before, word)
                more = len(word) - shared
                path = path[:shared] + list(range(base + new + 1, base + new + more + 1))
                new, before = new + more, word
                out.append(path)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, nodes])

    tail = f", {schema}" if schema else ""
    kept = saved(ordered.mapInArrow(number, f"{key} string{tail}, place long, {nodes} array<long>"), "trie-nodes")
    part = F.shiftright("place", 33)
    ends = kept.groupBy(part.alias("part")).agg(
        F.min(key).alias("first"), F.max(key).alias("last"), F.max_by(nodes, key).alias("path"))

    def rename(group: pd.DataFrame) -> pd.DataFrame:
        node, real, before, path = [], [], "", []
        for p, first, last, own in group.sort_values("part")[["part", "first", "last", "path"]].itertuples(index=False):
            # The first word of a partition has its nodes 1, 2, ... in order of their depth.
            shared = _common(before, first)
            known = {int(p) * PART + i + 1: path[i] for i in range(shared)}
            node += known.keys()
            real += known.values()
            before, path = last, [known.get(x, x) for x in own.tolist()]
        return pd.DataFrame({"node": node, "real": real}, dtype="int64")

    # A row for each partition, so one group.
    renamed = saved(ends.groupBy().applyInPandas(rename, "node long, real long"), "trie-renamed")
    return kept, renamed


def _real(pairs: DataFrame, column: str, renamed: DataFrame) -> DataFrame:
    few = renamed.limit(ALIAS_ROWS + 1).count() <= ALIAS_ROWS
    found = renamed.select(F.col("node").alias("_node"), F.col("real").alias("_real"))
    found = F.broadcast(found) if few else found
    return (
        pairs.join(found, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_real", column)).drop("_node", "_real")
    )


def pair_dictionary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered words: ``word``, ``n``, ``id`` ascending by word; their pairs: ``front``, ``back``, ``id``, ``n``,
    ``skip`` and ``last``, whether what is left out is the last of a run of equal letters)."""
    forward, forward_renamed = numbered_nodes(words, "word", "ahead")
    numbered = forward.withColumnRenamed("place", "id")
    turned = numbered.withColumn("turned", F.reverse("word"))
    backward, backward_renamed = numbered_nodes(turned, "turned", "behind")
    root = F.array(F.lit(0).cast("long"))
    rows = backward.select(
        "id", "n", F.concat(root, "ahead").alias("ahead"), F.reverse(F.concat(root, "behind")).alias("behind"),
        F.split("word", "").alias("letters"))
    splits = rows.select(
        "id", "n", F.explode(F.arrays_zip("ahead", "behind")).alias("pair"), F.lit(False).alias("skip"),
        F.lit(False).alias("last")).select("pair.*", "id", "n", "skip", "last")
    size = F.size("behind")
    ends = F.transform("letters", lambda x, i: F.get("letters", i + 1).eqNullSafe(x) == F.lit(False))
    skips = rows.select(
        "id", "n",
        F.explode(F.arrays_zip(
            F.slice("ahead", F.lit(1), size - 1).alias("ahead"), F.slice("behind", F.lit(2), size - 1).alias("behind"),
            ends.alias("last"))).alias("pair"),
    ).select("pair.ahead", "pair.behind", "id", "n", F.lit(True).alias("skip"), "pair.last")
    pairs = splits.unionByName(skips)
    pairs = _real(_real(pairs, "ahead", forward_renamed), "behind", backward_renamed)
    return numbered.select("word", "n", "id"), pairs


def near_words(pairs: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (``n`` and negative id of the near word of largest count)."""
    # The greater count first, then the smaller word.
    own = F.struct("n", (-F.col("id")).alias("less"))
    members = F.collect_list(F.struct(own.alias("word"), "skip", "last"))
    groups = pairs.groupBy("ahead", "behind").agg(members.alias("members")).where(F.size("members") > 1)

    def chosen(keep) -> Column:
        return F.sort_array(F.transform(F.filter("members", keep), lambda m: m["word"]), asc=False)

    groups = groups.select(
        "members", chosen(lambda m: m["skip"]).alias("skips"), chosen(lambda m: m["last"]).alias("longer"),
        chosen(lambda m: ~m["skip"]).alias("shorter"))
    own = groups.select(F.explode("members").alias("m"), "skips", "longer", "shorter").select("m.*", "skips", "longer", "shorter")
    replaced = F.when(F.get("skips", F.lit(0)) == F.col("word"), F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))
    left = F.when(F.col("last"), F.get("shorter", F.lit(0)))
    found = own.select(
        (-F.col("word.less")).alias("id"),
        F.when(F.col("skip"), F.size("skips") - 1 + F.when(F.col("last"), F.size("shorter")).otherwise(0))
        .otherwise(F.size("longer")).alias("n_near"),
        F.when(F.col("skip"), F.greatest(replaced, left)).otherwise(F.get("longer", F.lit(0))).alias("best"))
    return found.groupBy("id").agg(F.sum("n_near").cast("long").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``node`` and ``label``: where the form of each word leads, by doubling; a form's count is greater, so it ends."""
    while True:
        after = saved(
            join_labels(forms.withColumn("next", F.col("label")), "next", forms), "spelling-roots")
        if after.where(F.col("next") != F.col("label")).isEmpty():
            return forms
        forms = after.select("node", F.col("next").alias("label"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
             times: int = TIMES, factor: int = FACTOR, divisor: int = DIVISOR) -> DataFrame:
    """Every word as ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``."""
    words = saved(word_counts(docs, id_col, text_col, least, times, divisor), "spelling-words")
    numbered, pairs = pair_dictionary(words)
    near = near_words(pairs)
    found = numbered.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.n") >= factor * F.col("n"), -F.col("best.less")).alias("form_id"))
    found = saved(found, "spelling-near")
    forms = found.where(F.col("form_id").isNotNull()).select(F.col("id").alias("node"), F.col("form_id").alias("label"))
    roots = _roots(forms).select(F.col("node").alias("id"), F.col("label").alias("root_id"))
    by_id = found.select(F.col("id").alias("other"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    out = found.join(roots, "id", "left").join(by_id, F.col("form_id") == F.col("other"), "left")
    out = out.select("word", "n", "n_near", F.col("other_word").alias("form"), F.col("other_n").alias("form_n"), "root_id")
    tops = by_id.select(F.col("other").alias("root_id"), F.col("other_word").alias("root_word"))
    out = out.join(tops, "root_id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


by_value(__name__)
