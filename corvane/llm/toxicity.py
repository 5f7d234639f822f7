"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, its pairs of adjacent words and
its pairs of words one apart, whole text, in 2**bits slots. Training is online with a
learning rate per coordinate and an L1 penalty, so nearly all weights stay exactly zero;
the rest, a few thousand pairs of slot and weight, travel to the executors. Their number
is bounded by 2**bits whatever the data.

The model is fitted on a bounded sample of labelled rows (``sample_rows``), taken in a
seeded hash order. Scoring reads every text whole. Rate, penalty and class weight were chosen by
cross-validation within rows that may be learned from.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WordHash, mix64, small_batches, words_of

_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


def features(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Slots, repeats included, of the words, pairs and skip pairs of one text or several.

    Over several texts the caller must drop those pairs that cross a boundary.
    """
    shift = np.uint64(64 - bits)
    return (mix64(hashes) >> shift).astype(np.int64)


def text_features(words: list[bytes], seen: WordHash, bits: int) -> np.ndarray:
    """Distinct slots of one text; an empty text has none."""
    h = seen.array(words)
    parts = [features(h, bits)]
    if len(h) > 1:
        parts.append(features(h[:-1] * _PAIR + h[1:], bits))
    if len(h) > 2:
        parts.append(features(h[:-2] * _SKIP + h[2:], bits))
    return np.unique(np.concatenate(parts))


@dataclass
class Weights:
    """The learned slots with weights other than zero, sorted by slot."""

    bits: int
    slots: np.ndarray
    values: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, dtype=np.float32)
        w[self.slots] = self.values
        return w


class FtrlProximal:
    """Per-coordinate FTRL-proximal updates of logistic loss."""

    def __init__(self, bits: int, alpha: float = 0.2, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1):
        self.bits, self.alpha, self.beta, self.l1, self.l2 = bits, alpha, beta, l1, l2
        n = (1 << bits) + 1  # the last coordinate is the bias
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, slots: np.ndarray, label: float, weight: float = 1.0) -> float:
        at = np.append(slots, 1 << self.bits)
        w = self.weights(at)
        p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w.sum())))))
        g = (p - label) * weight
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown
        return p

    def export(self) -> Weights:
        slots = np.flatnonzero(np.abs(self.z[:-1]) > self.l1)
        bias = float(self.weights(np.array([1 << self.bits]))[0])
        return Weights(self.bits, slots, self.weights(slots).astype(np.float32), bias)


def bounded_labels(docs: DataFrame, labels: DataFrame, rows: int, seed: int) -> DataFrame:
    """``doc_id, label, text`` of documents with one of ``rows`` labels, first in a seeded order of hashes.

    An id that many documents share brings them all, so whoever uses this bounds the rows again after it.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where("label IS NOT NULL AND doc_id IS NOT NULL")
    picked = known.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "label").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")


def labelled_features(docs: DataFrame, labels: DataFrame, sample_rows: int, bits: int, seed: int) -> DataFrame:
    """``doc_id, label, slots`` of at most ``sample_rows`` labelled documents, however many share an id or a label's id."""
    rows = bounded_labels(docs, labels, sample_rows, seed)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()
        for b in batches:
            slots = [text_features(words_of(t), seen, bits).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array(slots, pa.binary())], ["doc_id", "label", "slots"]
            )

    found = small_batches(rows).select("doc_id", "label", "text").mapInArrow(featurise, "doc_id long, label int, slots binary")
    return found.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id", "label", F.xxhash64("slots")).limit(sample_rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 8000,
    bits: int = 20,
    epochs: int = 4,
    alpha: float = 5.0,
    l1_per_root: float = 0.3,
    positive_weight: float = 4.0,
    seed: int = 11,
) -> Weights:
    """Fits on a bounded sample of ``labels`` (``doc_id``, ``label`` 0 or 1).

    The L1 penalty grows with the root of the sample, as the sum of gradients of a slot without meaning does. A
    slot that only one sampled text has says nothing about others and is left out. Toxic texts are rare and count
    ``positive_weight`` times. Rows with a null label or id are left out; no rows at all give the
    model that scores every text 0.5.
    """
    # as Arrow, whose buffers are used as they come, so that the sample is held once
    sample = labelled_features(docs, labels, sample_rows, bits, seed).toArrow()
    rows = sorted(zip(sample.column("doc_id").to_pylist(), sample.column("label").to_pylist(), range(sample.num_rows), strict=True))
    target = np.array([label for _, label, _ in rows], dtype=np.float64)
    stored = list(sample.column("slots"))
    slots = [np.frombuffer(stored[i].as_buffer(), dtype="<i4") for _, _, i in rows]
    del sample, stored
    seen = np.zeros(1 << bits, dtype=np.int32)
    for x in slots:
        seen[x] += 1
    for i, x in enumerate(slots):  # one by one, so that the sample is never held twice
        slots[i] = x[seen[x] > 1]
    model = FtrlProximal(bits, alpha=alpha, l1=l1_per_root * math.sqrt(len(slots)))
    order = np.random.default_rng(seed)
    for _ in range(epochs if slots else 0):
        for i in order.permutation(len(slots)):
            model.learn(slots[i], target[i], positive_weight if target[i] else 1.0)
    return model.export()


def scorer(model: Weights) -> Callable[[str | None], float]:
    """The score of a whole text; null and empty texts get that of the bias alone."""
    dense, bits, seen = model.dense(), model.bits, WordHash()

    def rate(text: str | None) -> float:
        h = seen.array(words_of(text))
        slots = np.concatenate([features(x, bits) for x in (h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:])])
        live = slots[dense[slots] != 0]
        total = model.bias + (float(dense[np.unique(live)].sum(dtype=np.float64)) if len(live) else 0.0)
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, total))))

    return rate


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, score`` for every row; rows that repeat an id, or have none, are scored one by one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(shared.value)
        for b in batches:
            scores = pa.array([rate(t) for t in b.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), scores], ["doc_id", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def toxic_labels(labels: DataFrame) -> DataFrame:
    """Rows that may be learned from: CRC-32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).select(
        "doc_id", F.col("toxic").cast("int").alias("label")
    )


def drop_toxic(docs: DataFrame, weights: Weights, threshold: float = 0.7) -> DataFrame:
    """``docs`` without rows scored ``threshold`` or more; columns as they were, nothing shuffled.

    Each row goes by its own text, whether its id is null or repeated. Null and empty texts have the score of
    the bias. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(shared.value)
        for b in batches:
            yield b.filter(pa.array([rate(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
