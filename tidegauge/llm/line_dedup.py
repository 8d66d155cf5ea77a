"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words (lower case, split at ASCII white space). A line goes if an
earlier line, by document id and line number, has a Jaccard similarity of at least the
threshold with it. Lines are judged on the input, so a line that goes still removes others.

1. Words are counted, wherever they occur, in ``CELLS`` cells by hash. A cell's count is never
   below that of its words; its binary logarithm is a level from 0 to 9, and all levels are
   one constant of fixed size. Words ordered by level, then by hash, are ordered by rarity;
   any fixed order gives exact results, a coarse one costs candidates.
2. Equal sets are one class, with its first line and a number. A class has a posting for each
   word of its prefix, the n - ceil(threshold * n) + 1 rarest: two similar sets share one.
3. A word in the prefixes of more than ``OFTEN`` classes has a hub, the class with the first
   line of those, which the others are compared with first. So have each two of a class's
   ``PAIRED`` rarest words. That settles most lines of groups of variants, by a pair or a few
   for each line.
4. Postings meet by word, a part of the words at a time. Pairs whose later class is settled are
   left out; sizes (length filter), places in the order (positional filter) and the parity of
   hashed words (which bounds the difference of two sets) leave few pairs. Similar sets share
   not one of their first words but several, at places that move on with each; pairs that
   share fewer are left out.
5. Words are compared, for each class with the first of its candidates first, and with the
   others if that is not similar.

Postings are exchanged once and read on both sides of the join. The shuffle files of each
step are given back before the next.

Definitions. Hashes of words have 64 bits (56 in prefixes and in what tells classes apart,
of which there are 128 bits a set). A line without words stays. Null and empty texts have no
lines. Rows with equal ids and texts are one document; equal ids with different texts are
ordered by a hash of the text. A null id comes before all others. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import join_groups, release, saved

PERCENT = 80
CELLS = 1 << 18
LEVEL = 1 << 56
#: A word in more prefixes than this has a hub.
OFTEN = 1_000
#: Of a class's rarest words so many are paired; a pair of words has a hub, too.
PAIRED = 3
#: Hubs are broadcast up to this number.
FEW_HUBS = 20_000
#: Numbers of settled classes are broadcast up to this number.
FEW_SETTLED = 250_000
#: The bit of a posting's sizes, above the place, for a class that is settled.
SETTLED = 1 << 31
#: Parts of the words whose postings meet one after the other.
PASSES = 3
#: Common words that are counted at most.
SHARED = 4
#: 64 bits of parity each. Of unrelated sets with n words, half of all bits differ; of similar ones
#: up to 2 n / 9, so 64 bits tell lines of up to about 90 words apart and 128 those of up to 180.
PARITIES = ["parity0", "parity1"]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text_key``, ``text`` of the documents that have lines."""
    text = F.col(f"`{text_col}`")
    return docs.where(text.isNotNull() & (text != "")).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def _once(value: Column) -> Column:
    """The value as a generated column: what is selected from it later does not compute it again."""
    return F.explode(F.array(value))


def _folded() -> Column:
    """The text in lower case, with only blanks and line feeds as white space."""
    text = F.lower("text")
    for space in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return text


def _cell(h: Column) -> Column:
    return h.bitwiseAND(F.lit(CELLS - 1)).cast("int")


def _level_of(count: Column) -> Column:
    """0 to 9: a step for each factor of 4 from 2 on."""
    return F.greatest(F.lit(0), F.least(F.lit(9), F.floor(F.log2(count) / 2))).cast("tinyint")


def word_levels(docs: DataFrame) -> Column:
    """The level of each cell as a constant array, from how often its words occur."""
    words = F.split(F.replace(_folded(), F.lit("\n"), F.lit(" ")), " ")
    words = docs.select(F.explode(words).alias("word"))
    counted = words.where("word <> ''").groupBy(_cell(F.xxhash64("word")).alias("cell"))
    counted = counted.agg(_level_of(F.count("*").cast("double")).alias("level"))
    # A row of two small numbers for each cell, so CELLS of them at most.
    levels = bytearray(b"0" * CELLS)
    for cell, level in saved(counted, "word-levels").toLocalIterator():
        levels[cell] = ord("0") + level
    return F.split(F.lit(levels.decode()), "").cast("array<tinyint>")


def _parities(words: str) -> list[Column]:
    """A bit for each 128th of the words, set if a line has an odd number of them."""

    def parity(part: int) -> Column:
        own = F.filter(words, lambda x: x.bitwiseAND(F.lit(64)) == part * 64)
        return F.aggregate(own, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))

    return [parity(part).alias(name) for part, name in enumerate(PARITIES)]


def described(docs: DataFrame, levels: Column, percent: int) -> DataFrame:
    """Every line: ``id``, ``text_key``, ``line_no``, ``k1``, ``k2`` (null without words), ``n``, ``prefix``, parities."""
    lines = docs.select("id", "text_key", F.posexplode(F.split(_folded(), "\n")).alias("line_no", "line"))
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    hashes = F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))
    # An ordered word is one number: the level above, the hash without its upper bits below.
    ordered = F.transform(
        hashes,
        lambda h: F.shiftleft(F.get(levels, _cell(h)).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit(LEVEL - 1))))
    rows = lines.select("id", "text_key", "line_no", _once(F.sort_array(ordered)).alias("ordered"))
    n = F.size("ordered")
    some = n > 0
    return rows.select(
        "id", "text_key", "line_no",
        *[F.when(some, F.xxhash64(F.lit(seed), "ordered")).alias(k) for seed, k in ((1, "k1"), (2, "k2"))],
        n.alias("n"), F.slice("ordered", F.lit(1), (n - F.ceil(n * percent / 100) + 1).cast("int")).alias("prefix"),
        *_parities("ordered"),
    )


def classes(rows: DataFrame) -> DataFrame:
    """One row per set: ``number``, ``k1``, ``k2``, ``first`` (its first line), ``copies``, ``n``, ``prefix``, parities."""
    found = rows.where(F.col("k1").isNotNull()).groupBy("k1", "k2").agg(
        F.min(F.struct("id", "text_key", "line_no")).alias("first"), F.count("*").alias("copies"),
        *[F.any_value(c).alias(c) for c in ("n", "prefix", *PARITIES)])
    return found.withColumn("number", F.monotonically_increasing_id())


def _sizes(at: Column) -> Column:
    """The size of the set above, the place of a word in its order below."""
    return F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(at.cast("long")).alias("sizes")


def _postings(found: DataFrame, *others: str) -> DataFrame:
    """``word``, ``number``, ``sizes``, parities."""
    rows = found.select("number", "n", *PARITIES, *others, F.posexplode("prefix").alias("at", "word"))
    return rows.select("word", "number", _sizes(F.col("at")), *PARITIES, *others)


def _bounds(a: str, b: str, percent: int) -> tuple[Column, Column, Column]:
    """For two postings of one word: length and parity filter, the least overlap, and what is left after the word."""
    (n_a, at_a), (n_b, at_b) = (
        (F.shiftright(f"{x}sizes", 32), F.col(f"{x}sizes").bitwiseAND(F.lit(SETTLED - 1))) for x in (a, b))
    least = F.ceil((n_a + n_b) * percent / (100 + percent))
    near = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (
        reduce(add, [F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITIES]) <= n_a + n_b - 2 * least)
    return near, least, F.least(n_a - at_a, n_b - at_b)


def _shared(a: str, b: str, least: Column, percent: int) -> Column:
    """How many words two similar sets share in both prefixes, at least, counted up to ``SHARED``.

    A set has n - least words that are not shared at most, so the k-th shared word is among its
    first k + n - least, which are in the prefix for the first least - ceil(threshold * n) + 1.
    """
    larger = F.greatest(F.shiftright(f"{a}sizes", 32), F.shiftright(f"{b}sizes", 32))
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), least - F.ceil(larger * percent / 100) + 1))


def _hub_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x``, ``y`` of classes and the hubs of their frequent words that may match."""
    least = F.lit(OFTEN).cast("double")
    often = _postings(found, "first").where(F.col("word") >= F.shiftleft(_level_of(least).cast("long"), 56))
    hub = F.min(F.struct("first", "number", "sizes", *PARITIES)).alias("hub")
    hubs = often.groupBy("word").agg(F.count("*").alias("times"), hub).where(F.col("times") > OFTEN)
    hubs = saved(hubs.select("word", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in ("number", "sizes", *PARITIES)]), "hubs")
    few = hubs.limit(FEW_HUBS + 1).count() <= FEW_HUBS
    met = often.drop("first").join(F.broadcast(hubs) if few else hubs, "word")
    near, overlap, rest = _bounds("", "h_", percent)
    met = met.where((F.col("number") != F.col("h_number")) & near & (rest >= overlap))
    return met.select(F.col("h_number").alias("x"), F.col("number").alias("y")).distinct()


def _paired(found: DataFrame) -> DataFrame:
    """``word`` (a hash of two), ``first``, ``number``, ``sizes``, parities for each two of the rarest words of a class."""
    words = [F.get("prefix", F.lit(i)) for i in range(PAIRED)]
    both = [F.when(b.isNotNull(), F.xxhash64(a, b)) for i, a in enumerate(words) for b in words[i + 1 :]]
    return found.select("first", "number", _sizes(F.lit(0)), *PARITIES, F.explode(F.array_compact(F.array(*both))).alias("word"))


def _group_pairs(found: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x``, ``y`` of classes and the first class that has the same two rare words, if they may match.

    Two rare words are hardly ever in lines that are not variants of each other, so in a group of
    variants this leaves a pair or a few for each, not one for each two.
    """
    rows = _paired(found)
    hubs = rows.groupBy("word").agg(F.count("*").alias("times"), F.min(F.struct("first", "number", "sizes", *PARITIES)).alias("hub"))
    hubs = hubs.where("times > 1").select("word", "times", *[F.col(f"hub.{c}").alias(f"h_{c}") for c in ("number", "sizes", *PARITIES)])
    met = join_groups(rows.drop("first"), saved(hubs, "hubs"), ["word"], "times", F.lit(True))
    near, _, _ = _bounds("", "h_", percent)
    met = met.where((F.col("number") != F.col("h_number")) & near)
    return met.select(F.col("h_number").alias("x"), F.col("number").alias("y")).distinct()


def _marked(found: DataFrame, settled: DataFrame) -> DataFrame:
    """The classes as postings need them, with ``id`` of the first line and the bit ``mark`` of those that are settled."""
    few = settled.limit(FEW_SETTLED + 1).count() <= FEW_SETTLED
    marks = settled.select("number", F.lit(SETTLED).alias("mark"))
    rows = found.select("number", "n", *PARITIES, "prefix", F.coalesce("first.id", F.lit(-(1 << 63))).alias("id"))
    rows = rows.join(F.broadcast(marks) if few else marks, "number", "left").withColumn("mark", F.coalesce("mark", F.lit(0)))
    return rows if few else saved(rows, "line-classes")


def _pairs(found: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with enough common prefix words that may match.

    Left out are those of which the later class is settled; where ids are equal, if both are.
    """
    marked, parts = _marked(found, settled), []
    for part in range(PASSES):
        postings = _postings(marked, "id", "mark").where(F.pmod("word", F.lit(PASSES)) == part)
        postings = postings.withColumn("sizes", F.col("sizes").bitwiseOR(F.col("mark"))).drop("mark")
        # The same plan on both sides, so that postings are exchanged once.
        met = postings.alias("a").join(postings.alias("b"), F.col("a.word") == F.col("b.word"))
        done_a, done_b = (F.col(f"{x}.sizes").bitwiseAND(F.lit(SETTLED)) != 0 for x in "ab")
        over = (done_a & (F.col("a.id") > F.col("b.id"))) | (done_b & (F.col("b.id") > F.col("a.id"))) | (done_a & done_b)
        near, least, rest = _bounds("a.", "b.", percent)
        shared = _shared("a.", "b.", least, percent)
        met = met.where((F.col("a.number") < F.col("b.number")) & ~over & near & (rest >= least - shared + 1))
        met = met.groupBy(F.col("a.number").alias("x"), F.col("b.number").alias("y"))
        parts.append(saved(
            met.agg(F.count("*").alias("times"), F.max(shared).alias("shared"), F.max(rest - least).alias("spare")),
            "line-pairs"))
        release(parts[-1])
    every = reduce(DataFrame.unionByName, parts).groupBy("x", "y").agg(
        F.sum("times").alias("times"), F.max("shared").alias("shared"), F.max("spare").alias("spare"))
    return every.where((F.col("times") >= F.col("shared")) & (F.col("spare") >= 0)).select("x", "y")


def _ordered(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs as ``later`` and ``earlier`` by their first lines, with ``place`` of the earlier."""
    for end in ("x", "y"):
        places = found.select(F.col("number").alias(end), F.col("first").alias(f"{end}_first"))
        pairs = pairs.join(places, end)
    after = F.col("x_first") > F.col("y_first")
    return pairs.select(
        F.when(after, F.col("x")).otherwise(F.col("y")).alias("later"),
        F.when(after, F.col("y")).otherwise(F.col("x")).alias("earlier"),
        F.least("x_first", "y_first").alias("place"))


def _words(pairs: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """``number`` and ``words`` (of the first line) of the classes in pairs."""
    ends = pairs.select(F.explode(F.array("later", "earlier")).alias("number")).distinct()
    asked = found.join(ends, "number").groupBy("first.id", "first.text_key").agg(
        F.collect_list(F.struct("number", "first.line_no")).alias("asked"))
    asked = asked.select(F.col("id").alias("a_id"), F.col("text_key").alias("a_key"), "asked")
    same = docs["id"].eqNullSafe(F.col("a_id")) & (docs["text_key"] == F.col("a_key"))
    rows = docs.join(asked, same).select("asked", _once(F.split(_folded(), "\n")).alias("lines"))
    line = F.transform("asked", lambda a: F.struct(a["number"].alias("number"), F.get("lines", a["line_no"]).alias("line")))
    rows = rows.select(F.explode(line).alias("own"))
    # A row that repeats has the same lines.
    words = rows.groupBy(F.col("own.number").alias("number")).agg(
        F.any_value(F.array_distinct(F.array_remove(F.split("own.line", " "), ""))).alias("words"))
    words = saved(words, "line-words")
    release(words)
    return words


def _similar(pairs: DataFrame, words: DataFrame, percent: int) -> DataFrame:
    """``number`` of the later class of each pair that is similar."""
    met = pairs.select("later", "earlier")
    for end in met.columns:
        met = met.join(words.select(F.col("number").alias(end), F.col("words").alias(f"{end}_words")), end)
    met = met.withColumn("both", F.size(F.array_intersect("later_words", "earlier_words")))
    union = F.size("later_words") + F.size("earlier_words") - F.col("both")
    return met.where(F.col("both") * 100 >= union * percent).select(F.col("later").alias("number")).distinct()


def _verified(pairs: DataFrame, found: DataFrame, docs: DataFrame, percent: int) -> list[DataFrame]:
    """``number`` of the classes that are later in a similar pair, in two parts."""
    if pairs.isEmpty():
        return []
    ordered = saved(_ordered(pairs, found), "line-pairs")
    release(ordered)
    words = _words(ordered, found, docs)
    first = ordered.groupBy("later").agg(F.min_by("earlier", "place").alias("earlier"))
    settled = saved(_similar(saved(first, "line-first"), words, percent), "line-hits")
    release(settled)
    rest = ordered.join(settled.withColumnRenamed("number", "later"), "later", "left_anti").select("later", "earlier")
    rest = saved(rest.join(first, ["later", "earlier"], "left_anti"), "line-rest")
    if rest.isEmpty():
        return [settled]
    more = saved(_similar(rest, words, percent), "line-hits")
    release(more)
    return [settled, more]


def matched(found: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``number`` of the classes that match a class with an earlier first line."""
    none = found.select("number").limit(0)
    hubs = _hub_pairs(found, percent).unionByName(_group_pairs(found, percent)).distinct()
    by_hub = _verified(saved(hubs, "line-pairs"), found, docs, percent)
    settled = reduce(DataFrame.unionByName, by_hub, none)
    pairs = saved(_pairs(found, settled, percent), "line-pairs")
    release(pairs)
    return reduce(DataFrame.unionByName, _verified(pairs, found, docs, percent), settled).distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``id``, ``text_key`` and ``removed`` (sorted numbers, from 0) of the documents that lose lines."""
    rows = saved(described(docs, word_levels(docs), percent), "lines")
    release(rows)
    found = saved(classes(rows), "line-classes")
    release(found)
    similar = matched(found, docs, percent).withColumn("similar", F.lit(True))
    groups = found.select("number", "k1", "k2", "first", "copies").join(similar, "number", "left")
    groups = saved(groups.where((F.col("copies") > 1) | F.col("similar")), "line-groups")
    release(groups)
    # A class of one line needs no look at the lines.
    lone = groups.where(F.col("copies") == 1).select("first.*")
    many = groups.where(F.col("copies") > 1)
    total = many.agg(F.sum("copies")).first()[0] or 0
    # Sets with more than a thousandth of these lines number less than a thousand.
    hot = F.broadcast(many.where(F.col("copies") * 1000 > total))
    lines, keys = rows.select("k1", "k2", "id", "text_key", "line_no"), ["k1", "k2"]
    placed = lines.join(hot, keys).unionByName(
        lines.join(hot, keys, "left_anti").join(many.where(F.col("copies") * 1000 <= total), keys))
    place = F.struct("id", "text_key", "line_no")
    gone = placed.where(F.col("similar") | (place > F.col("first"))).select("id", "text_key", "line_no")
    return gone.unionByName(lone).groupBy("id", "text_key").agg(
        F.sort_array(F.collect_set("line_no")).alias("removed"))


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                with_text: bool = True) -> DataFrame:
    """Every row as ``doc_id``, ``n_lines``, ``n_removed``, ``removed`` and, if asked for, ``kept_text``."""
    found = removed_lines(_documents(docs, id_col, text_col), percent)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    n_lines = F.when(text == "", 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("own_key"),
                       n_lines.cast("long").alias("n_lines"), *[text.alias("text")] * with_text)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("text_key"))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    out = rows.join(found, same, "left").withColumn("removed", removed)
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("removed", i))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed",
                      *[F.array_join(kept, "\n").alias("kept_text")] * with_text)
