"""FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, its pairs of neighbours and its pairs with one word between, hashed to
2**BITS coordinates and counted once each. Each coordinate has its own learning rate, and L1 keeps most
weights at exactly zero, so what is handed to the scoring tasks is a short list of coordinates.

The model learns from at most TRAIN_ROWS labelled ids: those with the least hash, so the sample does not
depend on where rows lie. Of rows that repeat an id one is learned from. Only scoring sees all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .store import bounded_batches, written

BITS = 20
#: Rows that the model learns from at most, each of another id.
TRAIN_ROWS = 16_000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 4.0, 0.1, 4

_KINDS = tuple(np.uint64(x) for x in (11, 22, 33))


def features(c: W.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of each text, one after another, and their bounds. Coordinate 0 is every text's bias."""
    n, text = len(c.hash), c.text
    mask = np.uint64((1 << bits) - 1)
    own, all_ = [np.arange(c.count)], [np.zeros(c.count, np.uint64)]
    for kind, gap in zip(_KINDS, (0, 1, 2)):
        if n <= gap:
            continue
        a, b = c.hash[: n - gap], c.hash[gap:]
        same = text[: n - gap] == text[gap:]
        h = W.mix(W.mix(a, b), np.full(n - gap, kind, np.uint64)) & mask
        own.append(text[: n - gap][same])
        all_.append(h[same])
    owner = np.concatenate(own)
    key = np.unique((owner.astype(np.uint64) << np.uint64(32)) | np.concatenate(all_))
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64), np.searchsorted(key >> np.uint64(32), np.arange(c.count + 1))


@dataclass
class Ftrl:
    """State of the learner: z and n of each coordinate."""

    bits: int = BITS
    alpha: float = ALPHA
    beta: float = BETA
    l1: float = L1
    l2: float = L2

    def __post_init__(self):
        self.z, self.n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that are not zero.

    Learns from rows of labels that have a doc_id that is not held out and a toxic of 0 or 1. If no row of
    either kind is there the model is empty, and every score is one half.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(~held_out(labels["doc_id"]) & labels["doc_id"].isNotNull() & labels["toxic"].isin(0, 1))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "toxic-sample")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = plain.join(F.broadcast(sample), "doc_id").withColumn("turn", F.xxhash64("text"))  # at most `rows` rows of two numbers

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch.column(1), lower=True, marks=True):
                at, bounds = features(c)
                part = batch.slice(c.first, c.count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(at.astype(np.int32))), part.column(3)], names=["doc_id", "toxic", "at", "turn"])

    found = labelled.mapInArrow(encoded, "doc_id long, toxic int, at array<int>, turn long")
    # one row an id, picked where the rows are: however often an id stands there, the learner gets at most `rows` rows
    ready = written(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("at", "turn").alias("at")), "toxic-features")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, label, doc = [], [], []
        for batch in batches:
            doc.append(batch.column(0).to_numpy())
            label.append(batch.column(1).to_numpy())
            column = batch.column(2)
            flat, bounds = column.values.to_numpy(), column.offsets.to_numpy()
            at += [flat[a:b].copy() for a, b in zip(bounds, bounds[1:])]
        model = Ftrl()
        if at:
            label, doc = np.concatenate(label), np.concatenate(doc)
            if label.min() != label.max():
                for epoch in range(epochs):
                    salt = np.uint64(epoch + 1)
                    for i in np.lexsort((doc, W.mix(doc.view(np.uint64), np.full(len(doc), salt, np.uint64)))):
                        model.learn(at[i], int(label[i]))
        all_ = np.arange(len(model.z))
        w = model.weights(all_)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(w[some])], names=["at", "w"])

    found = written(ready.coalesce(1).mapInArrow(fit, "at int, w double"), "toxic-weights").toPandas()
    return found["at"].to_numpy(np.int64), found["w"].to_numpy(np.float64)


def score(docs: DataFrame, at: np.ndarray, w: np.ndarray) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; only the text decides the score."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((at, w))  # at most 2**BITS weights, a few thousand under L1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS)
        dense[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = []
            for c in W.chunks(batch.column(1), lower=True, marks=True):
                where, bounds = features(c)
                total = np.concatenate([[0.0], np.cumsum(dense[where])])
                out.append(1 / (1 + np.exp(-np.clip(total[bounds[1:]] - total[bounds[:-1]], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.concatenate(out), 12))], names=["doc_id", "score"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = plain.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The score of every row of docs by a model of labels.

    Null and empty texts have the score of a text without words. A null doc_id is not held out and has no
    label. Repeated rows are scored each and learned from once; of different texts of one doc_id that with the
    least hash is learned from. A doc_id with several labels counts as toxic if one says so, and an empty table
    gives no rows; other columns are left out.
    """
    return score(docs, *train(docs, labels))
