"""Quality classifier: supervised subword embeddings.

A word is the mean of learnt vectors of hashed buckets: its own and those of its character
n-grams. A document is the mean of its words and of the vectors of its hashed word
bigrams (a word followed by itself has a bucket of its own, whatever the word). A softmax
layer gives the probability of each label. All vectors are learnt together by stochastic
gradient descent in numpy, on a sample of labelled documents of at most ``sample`` rows
(those with the smallest hash of their id). Tasks write the features of the sample; each
epoch is a job whose one task reads them in an order of its own, batch by batch, and moves
the model. The model has a fixed size (6 MB) and is all that the driver holds.

Definitions. Only the text is an input of a score. Null and empty texts get the score of
the bias alone. Labels that are null are left out; of several labels of an id the greatest
counts. Without any training row the score is 0.5. Documents may repeat; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import U64, by_value, giving_back, hash_words, mix64, release, saved, slices, words_of

SAMPLE_ROWS = 5_000
DIMS, EPOCHS, RATE, SEED = 8, 4, 2.0, 7
# Buckets of words, of character n-grams and of word bigrams follow each other.
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SLICE_BYTES = 3_000_000
#: Bytes of distinct words whose n-grams are made at a time; those take some 150 times as much.
WORD_BYTES = 60_000


@dataclass
class Model:
    vectors: np.ndarray  # bucket x dimension
    weights: np.ndarray  # dimension x label
    bias: np.ndarray


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word of each bucket, hash of each word) of distinct words, ordered by word."""
    n = len(words)
    own = hash_words(words)
    lengths = np.array([len(w.encode()) for w in words.to_pylist()], np.int64)
    data = np.frombuffer("".join(words.to_pylist()).encode(), np.uint8)
    # Every word is framed, so that prefixes and suffixes differ from what is inside.
    word = np.repeat(np.arange(n), lengths + 2)
    ends = np.cumsum(lengths + 2)
    framed = np.full(len(word), ord("<"), np.uint8)
    framed[ends - 1] = ord(">")
    framed[np.arange(len(data)) + 2 * np.repeat(np.arange(n), lengths) + 1] = data
    buckets, owner = [(own & U64(BUCKETS - 1)).astype(np.int64)], [np.arange(n)]
    left = ends[word] - np.arange(len(word))
    for size in GRAMS:
        at = np.flatnonzero(left >= size)
        code = np.full(len(at), size, U64)
        for i in range(size):
            code = (code << U64(8)) | framed[at + i].astype(U64)
        buckets.append((mix64(code) & U64(BUCKETS - 1)).astype(np.int64) + BUCKETS)
        owner.append(word[at])
    buckets, owner = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], owner[order], own


def bigram_buckets(codes: np.ndarray, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each pair of neighbouring words."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(codes) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = doc[1:] == doc[:-1]
    a, b = codes[:-1][inside], codes[1:][inside]
    bucket = mix64(hashes[a] * U64(0x9E3779B97F4A7C15) + hashes[b]) % U64(BUCKETS - 1) + U64(1)
    return np.where(a == b, 0, bucket.astype(np.int64)) + 2 * BUCKETS, doc[:-1][inside]


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text with their weights in the mean."""
    codes, words, bounds = words_of(pa.array([text]))
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    buckets, owner, hashes = word_buckets(words)
    pairs, _ = bigram_buckets(codes, hashes, bounds)
    per_word = np.bincount(codes, minlength=len(words)) / np.bincount(owner)
    every = np.concatenate([buckets, pairs])
    weight = np.concatenate([per_word[owner], np.ones(len(pairs))]) / (len(codes) + len(pairs))
    found, place = np.unique(every, return_inverse=True)
    return found.astype(np.int32), np.bincount(place, weights=weight).astype(np.float32)


def start(seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (3 * BUCKETS, DIMS)).astype(np.float32)
    return Model(vectors, np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32))


def learn(model: Model, bucket: np.ndarray, weight: np.ndarray, label: int, step: np.float32) -> None:
    """One step of stochastic gradient descent over the sparse mean of a text."""
    hidden = weight @ model.vectors[bucket]
    z = hidden @ model.weights + model.bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    back = model.weights @ p
    model.weights -= step * np.outer(hidden, p)
    model.bias -= np.float32(0.1) * step * p
    model.vectors[bucket] -= step * weight[:, None] * back


def train(features: DataFrame, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Learn from a saved table of ``id``, ``label``, ``buckets``, ``weights``; the rate falls to zero linearly."""
    spark, model, rows = features.sparkSession, start(seed), features.count()
    if not rows:
        return Model(np.zeros_like(model.vectors), model.weights, model.bias)
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((model.vectors, model.weights, model.bias))

        def run(batches: Iterator[pa.RecordBatch], done: int = epoch * rows, sent=sent) -> Iterator[pa.RecordBatch]:
            own = Model(*[x.copy() for x in sent.value])
            for batch in batches:
                for label, bucket, weight in zip(*(batch.column(c) for c in ("label", "buckets", "weights"))):
                    step = np.float32(rate * (1 - done / (epochs * rows)))
                    learn(own, np.frombuffer(bucket.as_buffer(), np.int32), np.frombuffer(weight.as_buffer(), np.float32),
                          label.as_py(), step)
                    done += 1
            parts = [pa.array([x.tobytes()], pa.binary()) for x in (own.vectors, own.weights, own.bias)]
            yield pa.RecordBatch.from_arrays(parts, names=["vectors", "weights", "bias"])

        # The steps of an epoch follow each other: one task, over a sample of bounded size.
        ordered = features.coalesce(1).sortWithinPartitions(F.xxhash64("id", F.lit(seed + epoch)), "id")
        parts = ordered.mapInArrow(giving_back(run), "vectors binary, weights binary, bias binary").first()
        arrays = [np.frombuffer(bytes(p), np.float32) for p in parts]
        model = Model(*[a.reshape(x.shape) for a, x in zip(arrays, (model.vectors, model.weights, model.bias))])
        sent.unpersist()
    release(features)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE_ROWS,
        id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on at most ``sample`` of the given labels (id and label column, 0 or 1).

    Of rows with one id only one is learnt from, that with the greatest hash of its text.
    """
    chosen = (
        labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(F.max(f"`{label}`").cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # At most ``sample`` rows of two numbers are broadcast.
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id")
    order = F.struct(F.xxhash64("text"), "text")
    rows = rows.groupBy("id").agg(F.max("label").alias("label"), F.max_by("text", order).alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.string()), batch.column(1),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([w.tobytes() for _, w in found], pa.binary()),
                ],
                names=["id", "label", "buckets", "weights"],
            )

    rows = rows.mapInArrow(giving_back(extract), "id string, label int, buckets binary, weights binary")
    return train(saved(rows, "features"))


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 of each text."""
    codes, words, bounds = words_of(texts)
    total = np.zeros((len(texts), DIMS), np.float32)
    count = np.diff(bounds).astype(np.float32)
    if len(codes):
        means, hashes, a = np.empty((len(words), DIMS), np.float32), np.empty(len(words), U64), 0
        for part in slices(pa.RecordBatch.from_arrays([words], ["word"]), 0, WORD_BYTES):
            b = a + len(part)
            buckets, owner, hashes[a:b] = word_buckets(part.column(0))
            firsts = np.searchsorted(owner, np.arange(b - a + 1))
            n = np.diff(firsts)[:, None].astype(np.float32)
            means[a:b], a = np.add.reduceat(model.vectors[buckets], firsts[:-1]) / n, b
        some = np.flatnonzero(np.diff(bounds))
        total[some] = np.add.reduceat(means[codes], bounds[some])
        pairs, doc = bigram_buckets(codes, hashes, bounds)
        if len(pairs):
            some, firsts = np.unique(doc, return_index=True)
            total[some] += np.add.reduceat(model.vectors[pairs], firsts)
            count += np.bincount(doc, minlength=len(texts))
    z = (total / np.maximum(count, 1)[:, None]) @ model.weights + model.bias
    return 1 / (1 + np.exp((z[:, 0] - z[:, 1]).astype(np.float64)))


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the probability of label 1; a column of that name is replaced."""
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast((model.vectors, model.weights, model.bias))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for big in batches:
            for batch in slices(big, place, SLICE_BYTES):
                p = pa.array(probabilities(own, batch.column(place)))
                yield pa.RecordBatch.from_arrays([*batch.columns, p], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(giving_back(run), f"{schema}, `{name}` double")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for the fifth of ids of which no label is learnt."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % folds == 0


by_value(__name__)
