"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a sparse index vector of ``DIMENSIONS`` signs, fixed by its hash, so no vocabulary is
needed for it. Words of the bounded training sample also get a context vector: the sum of the index
vectors of their neighbours over *all* documents. A document is the mean of the index vectors of its
words beside the mean of their unit context vectors. Signs between words are words of their own, and
two events count as words: a word in capitals, and a word that repeats the one before it.

The network (one hidden layer) is trained with numpy on at most ``sample`` labelled documents, taken
in the order of a hash of their id; a fifth of them is kept aside to fit the temperature that its
probabilities are calibrated with. Everything else covers all documents.

Edge cases: a null or empty text has a zero vector and is scored like any other. Labels that are null
are left out; a doc_id labelled more than once counts by its mean label. Without both classes among
the labels the score is the share of label 1, or 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lagwise.llm import words as W

DIMENSIONS = 64
SIGNS = 4
#: Documents multiplied with the context vectors at a time.
SLICE = 256
_EVENTS = W.numbers(2, 21)  # capitals, repeat
_SUMS = 8


def _signs(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The non-zero places of index vectors and their signs."""
    for k in range(SIGNS):
        part = hashes >> np.uint64(8 * k)
        yield (part % np.uint64(DIMENSIONS)).astype(np.int64), np.where(part & np.uint64(128), 1.0, -1.0)


def _repeats(found: W.Words) -> np.ndarray:
    same = np.zeros(len(found.hash), dtype=bool)
    same[1:] = (found.hash[1:] == found.hash[:-1]) & (found.text[1:] == found.text[:-1])
    # a sign may stand between the two
    same[2:] |= (found.hash[2:] == found.hash[:-2]) & (found.text[2:] == found.text[:-2])
    return same


class Vectors(NamedTuple):
    """Hashes of the known words, sorted, and their unit context vectors."""

    hashes: np.ndarray
    context: np.ndarray

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _pool(found: W.Words, vectors: Vectors) -> np.ndarray:
    """One row per text of a piece: mean index vector, mean context vector."""
    out = np.zeros((found.texts, 2 * DIMENSIONS), dtype=np.float32)
    for at, sign in _signs(found.hash):
        out[:, :DIMENSIONS] += np.bincount(
            found.text * DIMENSIONS + at, weights=sign, minlength=found.texts * DIMENSIONS
        ).reshape(-1, DIMENSIONS)
    for event, seen in zip(_EVENTS, (found.upper > 1, _repeats(found))):
        each = np.bincount(found.text[seen], minlength=found.texts)
        for at, sign in _signs(np.array([event])):
            out[:, at[0]] += each * sign[0] * 2
    number = vectors.number(found.hash)
    known = np.flatnonzero(number >= 0)
    begin = np.searchsorted(found.text[known], np.arange(0, found.texts + SLICE, SLICE))
    for k in range(len(begin) - 1):
        some = known[begin[k] : begin[k + 1]]
        if len(some):
            rows = min(SLICE, found.texts - k * SLICE)
            size = len(vectors.hashes)
            held = np.bincount((found.text[some] - k * SLICE) * size + number[some], minlength=rows * size)
            out[k * SLICE : k * SLICE + rows, DIMENSIONS:] = held.reshape(rows, size).astype(np.float32) @ vectors.context
    return out / np.maximum(found.counts(), 1)[:, None].astype(np.float32)


def _context_sums(batches: Iterator[pa.RecordBatch], vectors, reach: int) -> Iterator[pa.RecordBatch]:
    """Sum over a partition of the index vectors of the neighbours of every known word."""
    known = vectors.value
    size = len(known.hashes) * DIMENSIONS
    total = np.zeros(size)
    for batch in batches:
        for found in W.words(batch.column(0), W.SIGNS_TOO):
            number = known.number(found.hash)
            signs = list(_signs(found.hash))
            for step in range(1, reach + 1):
                together = found.text[step:] == found.text[:-step]
                for centre, other in ((slice(None, -step), slice(step, None)), (slice(step, None), slice(None, -step))):
                    use = np.flatnonzero(together & (number[centre] >= 0))
                    row = number[centre][use] * DIMENSIONS
                    for at, sign in signs:
                        total += np.bincount(row + at[other][use], weights=sign[other][use], minlength=size)
    part = TaskContext.get().partitionId() % _SUMS
    yield pa.record_batch([pa.array([part], type=pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for sums in batch.column(1):
            own = np.frombuffer(sums.as_buffer(), dtype=np.float64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.record_batch([pa.array([0], type=pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])


def context_vectors(documents: DataFrame, hashes: np.ndarray, text: str, reach: int = 2) -> Vectors:
    """Context vectors of the given words over all documents.

    Each partition sends one table of fixed size; ``_SUMS`` tasks add them and the driver adds theirs.
    """
    if not len(hashes):
        return Vectors(hashes, np.zeros((0, DIMENSIONS), dtype=np.float32))
    shared = documents.sparkSession.sparkContext.broadcast(Vectors(hashes, np.zeros((0, 0))))
    schema = "part int, sums binary"
    parts = (
        documents.select(text).mapInArrow(lambda b: _context_sums(b, shared, reach), schema)
        .repartition(_SUMS, "part").mapInArrow(_add, schema).collect()
    )
    total = sum((np.frombuffer(r.sums, dtype=np.float64) for r in parts), np.zeros(len(hashes) * DIMENSIONS))
    context = total.reshape(-1, DIMENSIONS)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return Vectors(hashes, (context / np.where(norm > 0, norm, 1)).astype(np.float32))


class Network(NamedTuple):
    """Two layers on standardised inputs; the logit is divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: float
    temperature: float

    def logits(self, inputs: np.ndarray) -> np.ndarray:
        hidden = np.tanh((inputs - self.mean) / self.scale @ self.inner + self.inner_bias)
        return hidden @ self.outer + self.outer_bias

    def score(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(inputs) / self.temperature, -60, 60)))


def _loss(logits: np.ndarray, labels: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - labels * logits))


def train(inputs: np.ndarray, labels: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam over mini-batches of four fifths of the rows; the rest fits the temperature."""
    inputs, labels = inputs.astype(np.float64), labels.astype(np.float64)
    share = min(max(float(labels.mean()), 1e-6), 1 - 1e-6) if len(labels) else 0.5
    if len(labels) < 10 or labels.min() == labels.max():
        size = inputs.shape[1]
        return Network(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    random = np.random.default_rng(7)
    aside = np.zeros(len(labels), dtype=bool)
    aside[random.permutation(len(labels))[: len(labels) // 5]] = True
    mean, scale = inputs[~aside].mean(axis=0), inputs[~aside].std(axis=0) + 1e-6
    x, y = (inputs[~aside] - mean) / scale, labels[~aside]
    weights = [random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, 0.1, hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, size = 0, 256
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), size):
            part = order[at : at + size]
            inner = np.tanh(x[part] @ weights[0] + weights[1])
            slope = (1 / (1 + np.exp(-np.clip(inner @ weights[2] + weights[3], -60, 60))) - y[part]) / len(part)
            back = np.outer(slope, weights[2]) * (1 - inner**2)
            gradients = [x[part].T @ back + decay * weights[0], back.sum(axis=0), inner.T @ slope + decay * weights[2], slope.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(gradients):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] -= rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    fitted = Network(mean, scale, weights[0], weights[1], weights[2], float(weights[3][0]), 1.0)
    logits = fitted.logits(inputs[aside])
    temperatures = np.geomspace(0.25, 8, 60)
    best = min(temperatures, key=lambda t: _loss(logits / t, labels[aside])) if aside.any() else 1.0
    return fitted._replace(temperature=float(best))


class Model(NamedTuple):
    vectors: Vectors
    network: Network


def fit(
    documents: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
    sample: int = 12_000,
    vocabulary: int = 4096,
) -> Model:
    """Fit on at most ``sample`` labelled documents for which ``may_learn`` (over doc_id) holds.

    The sample travels to the driver as vectors, and its ``vocabulary`` most frequent words as hashes;
    both are bounded by these parameters.
    """
    spark = documents.sparkSession
    chosen = (
        labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(may_learn)
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = [(r.doc_id, r.label) for r in chosen.collect()]  # at most ``sample``
    chosen = F.broadcast(spark.createDataFrame(rows, "doc_id long, label int"))
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.join(chosen, "doc_id").select("doc_id", "label", "text")

    def frequent(batches):
        for batch in batches:
            seen = [np.unique(f.hash, return_counts=True) for f in W.words(batch.column(2), W.SIGNS_TOO)]
            hashes = np.concatenate([s[0] for s in seen] or [np.zeros(0, dtype=np.uint64)])
            counts = np.concatenate([s[1] for s in seen] or [np.zeros(0, dtype=np.int64)])
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(counts, type=pa.int64())], names=["hash", "n"])

    top = (
        texts.mapInArrow(frequent, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "hash").limit(vocabulary).collect()
    )
    hashes = np.sort(np.array([r.hash for r in top], dtype=np.int64).view(np.uint64))
    vectors = context_vectors(documents, hashes, text)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches):
        for batch in batches:
            for found in W.words(batch.column(2), W.SIGNS_TOO):
                rows = pa.array([r.tobytes() for r in _pool(found, shared.value)], type=pa.binary())
                part = batch.slice(found.first, found.texts)
                yield pa.record_batch([part.column(0), part.column(1), rows], names=["doc_id", "label", "vector"])

    held = texts.mapInArrow(pooled, "doc_id long, label int, vector binary").collect()
    held.sort(key=lambda r: (r.doc_id, r.vector))
    inputs = np.array([np.frombuffer(r.vector, dtype=np.float32) for r in held]).reshape(-1, 2 * DIMENSIONS)
    return Model(vectors, train(inputs, np.array([r.label for r in held], dtype=np.float64)))


def scored(documents: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1; a column of that name is replaced."""
    documents = documents.drop(score)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            found = [shared.value.network.score(_pool(f, shared.value.vectors)) for f in W.words(batch.column(names.index(text)), W.SIGNS_TOO)]
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.record_batch([*batch.columns, pa.array(values)], names=[*names, score])

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField(score, T.DoubleType())]))
