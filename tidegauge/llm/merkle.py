"""A Merkle manifest of a table, with a proof for every row by pointer jumping.

Every row is a leaf: a digest of its columns. The rows of a group (say, a source) make a
tree whose nodes have up to ``fan`` children in the order of the ids; the roots of these
trees, in the order of the groups, make one tree above them.

1. Leaves are numbered in the order of (group, id) by a range partition, so a group with a
   third of all rows is in many tasks. A leaf's place in its group gives its path.
2. Levels are built bottom-up: nodes are grouped by their parent, ``fan`` at most.
3. Every inner node has a pointer, first to its parent, and the sibling segments on the way
   there. A self-join replaces the pointer by that of the node it points to and appends that
   node's segments, which doubles the distance, until all point to the root. Nodes that do
   are left out of the later joins. The nodes pointed to become fewer by powers of ``fan``;
   once they are few they are broadcast, so no join meets a frequent key.
4. A leaf makes the last jump: its own segment, and those of its parent, reach the root.

Segments are kept for inner nodes only, a ``fan``-th of the leaves; a leaf's whole proof
exists only while its row is computed.

Definitions. H is the lower-case hex sha256; digests are hashed as hex text. A value is
``-`` if null, else its UTF-8 length, a colon, and the value. A null group is the first one;
in a group null ids come first, and rows with equal ids are ordered by their leaf. Repeated
rows are leaves of their own. Rows count as tampered with if five divides the CRC-32 of
their decimal id; null ids are not tampered with. A single leaf is subroot and root, and its
proof is H of nothing. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import join_groups, saved
from tidegauge.llm.numbering import numbered

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes pointed to are broadcast up to this number (some 4 KB each).
FEW_NODES = 4_000
#: The tree above the groups.
TOP = -1

_SEGMENTS = "array<struct<before:binary,after:binary>>"


def _value(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Digest (binary) of the columns' values."""
    return F.unhex(F.sha2(F.concat(*[_value(c) for c in columns]), 256))


def tampered_text(id_col: str, text: Column) -> Column:
    """The text, in lower case (A-Z) where five divides the CRC-32 of the decimal id."""
    chosen = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0
    return F.when(chosen, F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(text)


def leaves(docs: DataFrame, columns: tuple[str, ...], id_col: str, group_col: str,
           text_col: str) -> tuple[DataFrame, DataFrame]:
    """(leaves with ``tree``, ``place``, ``size`` of the tree, ``id``, ``digest``, ``changed``; ``tree`` and ``size``)."""
    as_is = [F.col(f"`{c}`") for c in columns]
    other = [tampered_text(id_col, v) if c == text_col else v for c, v in zip(columns, as_is)]
    group = F.col(f"`{group_col}`").cast("string")
    rows = docs.select(
        # Null comes before every text, and no group is null in a join.
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("group"),
        F.col(f"`{id_col}`").alias("id"), leaf(as_is).alias("digest"), leaf(other).alias("changed"),
    ).withColumn("changed", F.when(F.col("changed") != F.col("digest"), F.col("changed")))
    rows = numbered(saved(rows, "merkle-rows"), ["group", "id", "digest"], "number")
    groups = rows.groupBy("group").agg(F.min("number").alias("first"), F.count("*").alias("size"))
    groups = saved(numbered(groups, ["group"], "tree"), "merkle-groups")
    placed = join_groups(rows, groups, ["group"], "size", F.lit(True))
    placed = placed.select("tree", (F.col("number") - F.col("first")).alias("place"), "size", "id", "digest", "changed")
    return saved(placed, "merkle-leaves"), groups.select("tree", "size")


def _level(nodes: DataFrame, height: int, fan: int) -> DataFrame:
    """Parents (``tree``, ``height``, ``place``, ``size``, ``digest``, ``kids``: digests of the children)."""
    kids = F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"])
    parents = nodes.groupBy("tree", F.floor(F.col("place") / fan).alias("up"), "size").agg(kids.alias("kids"))
    digest = F.unhex(F.sha2(F.lower(F.array_join(F.transform("kids", lambda x: F.hex(x)), "")), 256))
    return parents.select(
        "tree", F.lit(height).alias("height"), F.col("up").alias("place"), "size", digest.alias("digest"),
        F.aggregate("kids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("kids"))


def build(nodes: DataFrame, most: int, fan: int) -> list[DataFrame]:
    """All levels above ``nodes``; ``most`` is the size of the largest tree, ``size`` that of a node's tree."""
    levels, width, height = [], 1, 0
    while width < most:
        height += 1
        # A tree takes part while it has several nodes at this height.
        nodes = saved(_level(nodes.where(F.col("size") > width), height, fan), "merkle-level")
        levels.append(nodes)
        nodes, width = nodes.select("tree", "place", "size", "digest"), width * fan
    return levels


def _linked(nodes: DataFrame, groups: int, fan: int) -> DataFrame:
    """Add ``to`` (the parent, null for the root) and ``at`` (the place among its children)."""
    wide = F.pow(F.lit(float(fan)), F.col("height")) < F.col("size")
    upper = (F.col("tree") != TOP) & F.lit(groups > 1)
    place = F.when(wide, F.col("place")).otherwise(F.col("tree"))
    parent = F.struct(
        F.when(wide, F.col("tree")).otherwise(F.lit(TOP)).cast("long").alias("tree"),
        F.when(wide, F.col("height") + 1).otherwise(1).cast("int").alias("height"),
        F.floor(place / fan).cast("long").alias("place"))
    return nodes.withColumns({
        "to": F.when(wide | upper, parent), "at": F.pmod(place, F.lit(fan)).cast("int"),
        "subroot": F.when(~wide & (F.col("tree") != TOP), F.col("digest")),
    })


def _segment(kids: Column, at: Column) -> Column:
    """The siblings before and after the child at place ``at``."""
    return F.struct(
        F.substring(kids, F.lit(1), at * 32).alias("before"),
        F.substring(kids, at * 32 + 33, F.octet_length(kids)).alias("after"))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(FEW_NODES + 1).count() <= FEW_NODES else table


def paths(inner: DataFrame, groups: int, fan: int) -> DataFrame:
    """Every inner node as ``node`` with ``kids``, ``segments`` to the root and ``subroot``, by doubling."""
    nodes = inner.withColumn("node", F.struct(
        F.col("tree").cast("long").alias("tree"), F.col("height").cast("int").alias("height"),
        F.col("place").cast("long").alias("place")))
    linked = _linked(nodes, groups, fan)
    parents = _few(nodes.select(F.col("node").alias("to"), F.col("kids").alias("run")))
    moving = saved(
        linked.join(parents, "to", "left").select(
            "node", "to", "kids", "subroot",
            F.when(F.col("to").isNull(), F.array().cast(_SEGMENTS)).otherwise(
                F.array(_segment(F.col("run"), F.col("at")))).alias("segments")),
        "merkle-pointers")
    every = moving.where(F.col("to").isNull())
    moving = moving.where(F.col("to").isNotNull())
    while not moving.isEmpty():
        # A target's pointer is as old as those that point to it, or is at the root.
        asked = moving.select(F.col("to").alias("node")).distinct()
        targets = saved(
            every.unionByName(moving).join(asked, "node").select(
                F.col("node").alias("to"), F.col("to").alias("next"), F.col("segments").alias("more"),
                F.col("subroot").alias("above")),
            "merkle-targets")
        jumped = saved(
            moving.join(_few(targets), "to").select(
                "node", F.col("next").alias("to"), "kids", F.coalesce("subroot", "above").alias("subroot"),
                F.concat("segments", "more").alias("segments")),
            "merkle-pointers")
        every = every.unionByName(jumped.where(F.col("to").isNull()))
        moving = jumped.where(F.col("to").isNotNull())
    return every.select("node", "kids", "segments", "subroot")


def folded(start: Column, proof: Column) -> Column:
    """The root (binary) that a leaf and its proof lead to."""
    def step(digest: Column, s: Column) -> Column:
        run = F.concat(F.hex(s["before"]), F.hex(digest), F.hex(s["after"]))
        return F.unhex(F.sha2(F.lower(run), 256))

    return F.aggregate(proof, start, step)


def hexed(digest: str | Column) -> Column:
    return F.lower(F.hex(digest))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source",
             text_col: str = "text", fan: int = FAN) -> DataFrame:
    """Every row as ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof`` (sibling segments from the leaf
    to the root) and ``changed`` (the leaf after tampering, null if it is the same), digests in binary."""
    rows, trees = leaves(docs, columns, id_col, group_col, text_col)
    groups, most = trees.agg(F.count("*"), F.max("size")).first()
    levels = build(rows.select("tree", "place", "size", "digest"), most or 0, fan)
    # A tree's root is a lone leaf or the node of the first height at which there is one only.
    lone = [rows.where(F.col("size") == 1).select("tree", "digest")]
    tops = [
        level.where((F.col("size") > fan**h) & (F.col("size") <= fan ** (h + 1))).select("tree", "digest")
        for h, level in enumerate(levels)
    ]
    subroots = reduce(DataFrame.unionByName, lone + tops)
    subroots = saved(
        subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").cast("long").alias("place"),
                        F.lit(groups).cast("long").alias("size"), "digest"),
        "merkle-subroots")
    upper = build(subroots, groups, fan)
    root = bytes((upper[-1] if upper else subroots).first().digest) if groups else b""
    every = levels + upper
    linked = _linked(rows.withColumn("height", F.lit(0)), groups, fan)
    if every:
        known = paths(reduce(DataFrame.unionByName, every), groups, fan).select(
            F.col("node").alias("to"), "kids", "segments", F.col("subroot").alias("above"))
        linked = linked.join(known, "to", "left")
        own = F.concat(F.array(_segment(F.col("kids"), F.col("at"))), F.col("segments"))
        proof = F.when(F.col("to").isNull(), F.array().cast(_SEGMENTS)).otherwise(own)
        linked = linked.withColumn("proof", proof).withColumn("subroot", F.coalesce("subroot", "above"))
    else:
        linked = linked.withColumn("proof", F.array().cast(_SEGMENTS))
    return linked.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof",
        "changed")


def digest(found: DataFrame) -> DataFrame:
    """``manifest``'s rows with hex digests, ``proof_sha256``, ``folded_root`` and ``verified``."""
    siblings = F.transform("proof", lambda s: hexed(F.concat(s["before"], s["after"])))
    found = found.withColumn("folded", folded(F.coalesce("changed", "leaf"), F.col("proof")))
    return found.select(
        "doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        F.sha2(F.array_join(siblings, ""), 256).alias("proof_sha256"), hexed("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"))
