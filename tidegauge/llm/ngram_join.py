"""N-gram Jaccard join by vertical partitioning.

A document is the set of the hashes of its word n-grams. The global order of all n-grams
(the order of their hashes) is cut into fragments, so that a document is cut into segments,
and everything that counts n-grams is done per fragment and summed per document or pair:

1. ``sets``: the segments of all documents meet in their fragments, where it is counted in
   how many documents an n-gram occurs. What occurs once cannot be shared. A document whose
   shared n-grams, summed over the fragments, are fewer than the threshold asks for has no
   partner. The others keep their shared n-grams in order of rarity.
2. ``candidates``: two similar sets share an n-gram in their prefixes, the rarest
   n - ceil(threshold * n) + 1 of each. Only documents in one posting list of a prefix
   n-gram, and of fitting sizes, are compared.
3. ``overlaps``: for each pair, segment is compared with segment, and the partial overlaps
   are summed.

Documents with equal sets are one node from the start. Nodes of one posting list are not
all compared with each other: each is compared with one of them, which joins near copies
of a document into components after a few rounds. Comparisons inside a component say
nothing new and are left out; at the end all pairs that share a prefix n-gram across two
components are compared. So components are exact, while a group of n near copies of a
document costs a multiple of n.

N-grams in more than a 20,000th of all set sizes (so at most 20,000 of them; they are found
by their frequency inside tasks) bypass the fragments, as they would fill single ones.

Hashes have 64 bits, of which at least 52 tell n-grams apart in comparisons.

Definitions. A-Z are lower-cased. A text of fewer than n words is one n-gram; a null text
or one without words is empty and linked with nothing. Rows with equal sets are linked, so
repeated rows are. A row with a null id keeps its size and has no component. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import (
    U64, by_value, giving_back, hash_runs, hash_words, join_groups, mix64, release, saved, slices, words_of,
)
from tidegauge.llm.components import join_labels, merge_components

WORDS, PERCENT = 5, 80
SLICE_BYTES = 8_000_000
FRAGMENT_GRAMS, MIN_BITS, MAX_BITS, LOW_BITS = 500_000, 4, 16, 48
HOT_PARTS = 20_000
SEGMENTS = 8
HUB_ROUNDS = 2

_PACKED = "key long, hot boolean, ids binary, tags binary, sizes binary, counts binary, grams binary, dfs binary"


# -- sets in a slice of texts ------------------------------------------------------------


def gram_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of each distinct n-gram of each text, in that order."""
    codes, distinct, bounds = words_of(pc.ascii_lower(texts))
    hashes = hash_words(distinct)[codes]
    gram, at = hash_runs(hashes, bounds, words)
    text = np.searchsorted(bounds, at, side="right") - 1
    counts = np.diff(bounds)
    for n in range(1, words):
        if (counts == n).any():
            run, place = hash_runs(hashes, bounds, n)
            own = np.searchsorted(bounds, place, side="right") - 1
            whole = counts[own] == n
            gram, text = np.concatenate([gram, run[whole]]), np.concatenate([text, own[whole]])
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    return text[new], gram[new]


def set_digests(text: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit digests) of each of ``n`` sets."""
    sizes = np.bincount(text, minlength=n)
    digests = []
    for salt in (1, 2):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(gram ^ mix64(np.array([salt], U64))), dtype=U64)])
        ends = np.cumsum(sizes)
        digests.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return sizes, digests[0], digests[1]


def needed(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The smallest overlap that a set of each size can have with a partner."""
    return -(-sizes * percent // 100)


# -- packed segments: planes of bytes compress well -----------------------------------


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _values(parts, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    out = [np.frombuffer(p, np.uint8).reshape(wide, -1).T.copy().view(dtype).ravel() for p in parts]
    return np.concatenate(out) if out else np.zeros(0, dtype)


def _pack(key, doc, ids, tags, sizes, grams, dfs=None, hot=False, width=8) -> Iterator[dict]:
    """A row per key with its documents and their n-grams; ``doc`` numbers the documents of each n-gram."""
    order = np.lexsort((doc, key))
    key, doc, grams = key[order], doc[order], grams[order]
    cuts = np.flatnonzero(np.diff(key, prepend=key[0] - 1)) if len(key) else []
    for a, b in zip(cuts, [*cuts[1:], len(key)]):
        first = a + np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        own = doc[first]
        raw = grams[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        yield {
            "key": int(key[a]), "hot": hot,
            "ids": _planes(ids[own]), "tags": _planes(tags[own]), "sizes": _planes(sizes[own]),
            "counts": _planes(np.diff([*first, b]).astype(np.int32)), "grams": raw.tobytes(),
            "dfs": None if dfs is None else _planes(dfs[order][a:b]),
        }


def _unpack(rows: pd.DataFrame, width: int):
    """(id, tag, size) of each document segment, segment of each n-gram, n-grams."""
    ids, tags = _values(rows["ids"], np.int64), _values(rows["tags"], np.int32)
    sizes, counts = _values(rows["sizes"], np.int32), _values(rows["counts"], np.int32)
    raw = np.frombuffer(b"".join(rows["grams"]), np.uint8).reshape(-1, width)
    grams = np.zeros((len(raw), 8), np.uint8)
    grams[:, :width] = raw
    return ids, tags, sizes, np.repeat(np.arange(len(counts)), counts), grams.view("<u8").ravel()


# -- step 1 -------------------------------------------------------------------------


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Kind 0: size and digests of every row. Kind 1: n-grams that are frequent in a slice, with their count."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "id", "n", "d1", "d2"]
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                text, gram = gram_sets(batch.column(1), words)
                n, d1, d2 = set_digests(text, gram, batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), np.int32)), batch.column(0), pa.array(n), pa.array(d1), pa.array(d2)],
                    names=names,
                )
                found, times = np.unique(gram, return_counts=True)
                often = times >= max(8, len(gram) / HOT_PARTS)
                rest = pa.nulls(int(often.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(len(rest), np.int32)), rest, pa.array(times[often]),
                     pa.array(found[often].view(np.int64)), rest],
                    names=names,
                )

    return docs.mapInArrow(giving_back(describe), "kind int, id long, n long, d1 long, d2 long")


def sets(docs: DataFrame, hot: dict[int, int], bits: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents that may have a partner: ``id``, ``tag``, ``n``, ``grams`` (those shared, rarest first).

    ``tag`` is part of the set's digest; with it, rows that share an id are told apart.
    """
    hot_grams = np.array(sorted(hot), np.int64).view(U64)
    hot_grams.sort()
    hot_dfs = np.array([hot[int(g)] for g in hot_grams.view(np.int64)], np.int64)
    top = U64(64 - bits)
    low = U64((1 << LOW_BITS) - 1)
    names = [c.split()[0] for c in _PACKED.split(", ")]
    arrow = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), *[pa.binary()] * 6])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 1, SLICE_BYTES):
                text, gram = gram_sets(batch.column(1), words)
                n, d1, d2 = set_digests(text, gram, batch.num_rows)
                ids, sizes = np.asarray(batch.column(0), np.int64), n.astype(np.int32)
                tags = (d1 >> 32).astype(np.int32)
                # Of equal sets in the slice only the smallest id goes on; the others are its copies.
                order = np.lexsort((ids, d2, d1))
                first = np.ones(len(order), bool)
                first[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
                goes = np.zeros(len(order), bool)
                goes[order[first]] = True
                text, gram = text[goes[text]], gram[goes[text]]
                place = np.searchsorted(hot_grams, gram)
                frequent = np.zeros(len(gram), bool)
                if len(hot_grams):
                    frequent = hot_grams[np.minimum(place, len(hot_grams) - 1)] == gram
                rows = list(_pack(
                    (gram[~frequent] >> top).astype(np.int64), text[~frequent], ids, tags, sizes,
                    gram[~frequent] & low, width=LOW_BITS // 8,
                ))
                spread = (mix64(ids[text[frequent]].view(U64)) >> top).astype(np.int64)
                rows += _pack(spread, text[frequent], ids, tags, sizes, place[frequent].astype(U64),
                              hot=True, width=LOW_BITS // 8)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        flags = rows["hot"].to_numpy(bool)
        for is_hot in (False, True):
            own = rows[flags == is_hot]
            if not len(own):
                continue
            ids, tags, sizes, segment, gram = _unpack(own, LOW_BITS // 8)
            if is_hot:
                full, df = hot_grams[gram.astype(np.int64)], hot_dfs[gram.astype(np.int64)]
                gram = ((full >> top) << U64(LOW_BITS)) | (full & low)
                shared = np.ones(len(gram), bool)
            else:
                order = np.argsort(gram, kind="stable")
                start = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
                times = np.diff([*start, len(gram)])
                df = np.empty(len(gram), np.int64)
                df[order] = np.repeat(times, times)
                shared = df > 1
                gram = gram | U64(key[0] << LOW_BITS)
            bucket = (mix64(ids[segment[shared]].view(U64)) >> top).astype(np.int64)
            dfs = np.minimum(df[shared], 2**31 - 1).astype(np.int32)
            parts += _pack(bucket, segment[shared], ids, tags, sizes, gram[shared], dfs=dfs)
        return pd.DataFrame(parts, columns=names)

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids, tags, sizes, segment, gram = _unpack(rows, 8)
        df = _values(rows["dfs"], np.int32)
        order = np.lexsort((gram, df, tags[segment], ids[segment]))
        segment, gram = segment[order], gram[order]
        i, t = ids[segment], tags[segment]
        start = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
        end = np.array([*start[1:], len(gram)])
        n = sizes[segment[start]]
        keep = (end - start) >= needed(n, percent)
        return pd.DataFrame({
            "id": i[start][keep], "tag": t[start][keep], "n": n[keep].astype(np.int64),
            "grams": pd.Series([gram[a:b].view(np.int64) for a, b in zip(start[keep], end[keep])], dtype=object),
        })

    counted = docs.mapInArrow(giving_back(cut), _PACKED).groupBy("key").applyInPandas(count, _PACKED)
    return counted.groupBy("key").applyInPandas(gather, "id long, tag int, n long, grams array<long>")


# -- steps 2 and 3 --------------------------------------------------------------------


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Overlap of each pair (``a``, ``b``): partial counts per fragment, summed."""
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("a_grams"))
    right = segments.select(
        F.col("node").alias("b"), F.col("fragment").alias("b_fragment"), F.col("grams").alias("b_grams")
    )
    return (
        pairs.join(left, "a")
        .join(right, ["b"])
        .where(F.col("fragment") == F.col("b_fragment"))
        .groupBy("a", "b")
        .agg(F.sum(F.size(F.array_intersect("a_grams", "b_grams"))).alias("overlap"))
    )


def _least_overlap(n_a, n_b, percent: int):
    return F.ceil((n_a + n_b) * percent / (100 + percent))


def _fits(a: str, b: str, percent: int):
    """Whether sizes and shared n-grams (``n``, ``r`` under two prefixes) leave room for a link."""
    n_a, n_b, r = F.col(f"{a}n"), F.col(f"{b}n"), F.least(f"{a}r", f"{b}r")
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (r * 100 >= (n_a + n_b - r) * percent)


def _prefix_size(n, percent: int):
    return n - F.ceil(n * percent / 100) + 1


def _promising(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes, the first fragment to be counted, share enough for a link.

    Of the set whose prefix ends first in the order, all n-grams of the prefix that the
    other set has are in the other's prefix too. So it lacks the rest of its prefix.
    """
    a = heads.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("head").alias("a_head"))
    b = heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("head").alias("b_head"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    both = F.size(F.array_intersect("a_head", "b_head"))
    least = _least_overlap(n_a, n_b, percent)
    enough = F.least(*[least - n + _prefix_size(n, percent) for n in (n_a, n_b)])
    return pairs.join(a, "a").join(b, "b").where(both >= enough).select("a", "b")


def _similar(pairs: DataFrame, nodes: DataFrame, heads: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked."""
    sizes = nodes.select("node", "n")
    found = overlaps(saved(_promising(pairs, heads, percent), "promising"), segments)
    found = found.join(sizes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
    found = found.join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return found.where(F.col("overlap") * 100 >= union * percent).select("a", "b")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def node_labels(nodes: DataFrame, percent: int = PERCENT, rounds: int = HUB_ROUNDS) -> DataFrame:
    """``node`` and ``label``, equal for nodes of a component. ``nodes``: ``node``, ``n``, ``grams``."""
    # The n-grams of a document alone, which come first, are not among its shared ones.
    alone = F.col("n") - F.size("grams")
    prefix = F.slice("grams", F.lit(1), (_prefix_size(F.col("n"), percent) - alone).cast("int"))
    postings = nodes.select("node", "n", F.size("grams").alias("r"), F.posexplode(prefix).alias("at", "gram"))
    # The place in the order of all n-grams: those of the document alone come first.
    postings = postings.withColumn("at", F.col("n") - F.col("r") + F.col("at") + 1)
    shared = postings.groupBy("gram").agg(F.count("*").alias("times")).where(F.col("times") > 1).select("gram")
    postings = saved(postings.join(shared, "gram"), "postings")
    fragment = F.pmod(F.xxhash64("gram"), F.lit(SEGMENTS))
    segments = saved(
        nodes.select("node", F.explode("grams").alias("gram"))
        .withColumn("fragment", fragment)
        .groupBy("node", "fragment")
        .agg(F.collect_list("gram").alias("grams")),
        "segments",
    )
    heads = saved(nodes.select("node", "n", prefix.alias("head")), "heads")
    labels = nodes.select("node", F.col("node").alias("label"))
    tested = None

    def compared(pairs: DataFrame) -> None:
        """Compare pairs that were not compared before, and merge the labels of those that are linked."""
        nonlocal labels, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = saved(pairs, "pairs")
        if pairs.isEmpty():
            return
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _similar(pairs, nodes, heads, segments, percent)
        links = join_labels(join_labels(links, "a", labels), "b", labels)
        labels = saved(join_labels(labels, "label", merge_components(links)), "node-labels")
        release(labels)

    for number in range(rounds):
        here = postings.join(labels, "node")
        # What has been copied has fewer n-grams of its own than its copies, which may be alike
        # only through it. The rounds after the first take any member.
        own = (F.col("n") - F.col("r")) if number == 0 else F.lit(0)
        hub = F.min_by(F.struct("node", "n", "r", "label"), F.struct(own, F.xxhash64("node", F.lit(number))))
        open_ = here.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high"), hub.alias("hub"))
        pairs = here.join(open_.where(F.col("low") < F.col("high")), "gram")
        pairs = pairs.where((F.col("label") != F.col("hub.label")) & _fits("", "hub.", percent))
        compared(pairs.select(*_ordered(F.col("node"), F.col("hub.node"))).distinct())
    # What is left: pairs across components, one of which is not the largest of its posting list.
    here = saved(postings.join(labels, "node"), "labelled")
    members = here.groupBy("gram", "label").agg(F.count("*").alias("times"))
    main = members.groupBy("gram").agg(F.count("*").alias("labels"), F.max_by("label", "times").alias("main"))
    main = main.where(F.col("labels") > 1).select("gram", "main")
    opened = here.join(main, "gram")
    strays = opened.where(F.col("label") != F.col("main")).select(
        "gram", *[F.col(c).alias(f"s_{c}") for c in ("node", "n", "r", "at", "label")])
    # From the first n-gram that two sets share, enough must follow in both.
    rest = F.least(F.col("n") - F.col("at"), F.col("s_n") - F.col("s_at")) + 1
    pairs = opened.join(strays, "gram").where(
        (F.col("label") != F.col("s_label")) & _fits("", "s_", percent)
        & (rest >= _least_overlap(F.col("n"), F.col("s_n"), percent))
    )
    compared(pairs.select(*_ordered(F.col("node"), F.col("s_node"))).distinct())
    return labels


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Every row's ``doc_id``, ``n_shingles`` and ``component_id`` (smallest id reachable by links)."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    described = saved(_described(docs, words), "described")
    rows = described.where(F.col("kind") == 0).select("id", "n", "d1", "d2")
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = described.where(F.col("kind") == 1).groupBy("d1").agg(F.sum("n").alias("df"))
    # No more than HOT_PARTS n-grams can make up that part of all sets each.
    hot = {g: df for g, df in often.where(F.col("df") * HOT_PARTS >= total).collect()}
    bits = int(np.clip(np.ceil(np.log2(total / FRAGMENT_GRAMS + 1)), MIN_BITS, MAX_BITS))
    classes = saved(
        rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy("d1", "d2", "n")
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies")),
        "classes",
    )
    tag = F.shiftright("d1", 32).cast("int")
    found = sets(docs.where(F.col("id").isNotNull()), hot, bits, words, percent)
    reps = classes.select(F.col("rep").alias("id"), tag.alias("tag"), "d1", "d2")
    nodes = saved(found.join(reps, ["id", "tag"]).withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(nodes)
    labels = node_labels(nodes.select("node", "n", "grams"), percent)
    placed = nodes.select("node", "id", "d1", "d2").join(labels, "node")
    least = placed.groupBy("label").agg(F.min("id").alias("least"))
    placed = placed.join(least, "label").select("d1", "d2", "least")
    classes = saved(
        classes.join(placed, ["d1", "d2"], "left").select(
            "d1", "d2", "copies", F.coalesce("least", "rep").alias("component_id")),
        "class-components",
    )
    joined = join_groups(rows, classes, ["d1", "d2"], "copies", F.col("n") > 0)
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
                         F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


by_value(__name__)
