"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, of its pairs of neighbours and of its pairs with one word between,
each hashed to one of 2**BITS coordinates. Every coordinate has its own learning rate, and L1 keeps most weights at
exactly zero, so the model that is broadcast holds a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import textkit
from edgetide.llm.neardup import portions
from edgetide.llm.runtime import and_double, bounded_rows, bounded_sample, prepare

BITS = 20
#: Labelled documents that a model is fitted on at most (about; chosen by a hash of doc_id).
TRAIN_ROWS = 12_000
_U = np.uint64
_MARK = {0: _U(0x51ED270B4C2D9C4F), 1: _U(0xA24BAED4963EE407), 2: _U(0x9FB21C651E98DF25)}


@dataclass(frozen=True)
class Model:
    """Sparse weights: coordinate, value; and the intercept."""

    at: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS)
        w[self.at] = self.value
        return w


def features(h: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, coordinate) of unigrams, bigrams and one-word skip-grams; repeats within a row are kept."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    index, _ = textkit.runs(low, n)
    for gap in (0, 1, 2):
        x = h[index] ^ _MARK[gap]
        r = row
        if gap:
            ok = np.flatnonzero(row[:-gap] == row[gap:]) if len(row) > gap else np.zeros(0, np.int64)
            r = row[ok]
            x = textkit.mix(x[ok] + h[index[ok + gap]] * _U(3))
        yield r, (x >> _U(64 - BITS)).astype(np.int64)


def fit(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.01) -> Model:
    """rows: the coordinates of each text. The last coordinate is the intercept, which L1 spares.

    A text holds thousands of features that say nothing, so L1 is strong: a weight leaves zero only after several texts
    have pulled it the same way.
    """
    dim = (1 << BITS) + 1
    z, n = np.zeros(dim), np.zeros(dim)
    rate = np.random.Generator(np.random.PCG64(5))

    def weights(i):
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(zi) <= l1] = 0
        return w

    rows = [np.r_[r, dim - 1] for r in rows]
    for _ in range(epochs):
        for k in rate.permutation(len(rows)):
            i = rows[k]
            w = weights(i)
            w[-1] = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            ni = n[i]
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    every = weights(np.arange(dim - 1))
    at = np.flatnonzero(every)
    return Model(at, every[at], float(-z[-1] / ((beta + np.sqrt(n[-1])) / alpha)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's coordinates, without repeats; from here on no text travels."""
    for batch in batches:
        data, starts, ends = textkit.view(batch.column("text"))
        rows = []
        for lo, hi in portions(starts, ends):
            h, low, high = textkit.words(data, starts[lo:hi], ends[lo:hi], textkit.ALNUM)
            got = [*features(h, low, high)]
            row, at = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            both = np.unique(row << BITS | at)
            cut = np.searchsorted(both, np.arange(hi - lo + 1) << BITS)
            coordinate = (both & ((1 << BITS) - 1)).astype(np.int32)
            rows += [coordinate[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "at"])


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bounded task: the sample's features in an order of their own to a model's weights."""
    ids, labels, rows = [], [], []
    for batch in batches:
        rows += [np.frombuffer(x, np.int32) for x in batch.column("at").to_pylist()]
        ids += batch.column("doc_id").to_pylist()
        labels += batch.column("label").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], labels[i], len(rows[i]), rows[i].tobytes()))
    m = fit([rows[i] for i in order], np.array([labels[i] for i in order], float))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[m.at, -1]), pa.array(np.r_[m.value, m.bias])], names=["at", "value"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled documents: docs (doc_id, text), labels (doc_id, label 0 or 1).

    Several labels of a document count as their maximum; null labels and null ids don't count; a null text is an empty
    one. About ``bound`` documents at most are used, also where ids repeat. Without labels the model scores 0.5
    everywhere.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = bounded_sample(known, "doc_id", bound, 8)
    joined = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    sample = bounded_rows(joined, 2 * bound, 9).mapInArrow(_features, "doc_id long, label int, at binary")
    rows = sample.repartition(1).mapInArrow(_fit_task, "at long, value double").collect()
    pairs = {r["at"]: r["value"] for r in rows}
    bias = pairs.pop(-1, 0.0)
    at = np.array(sorted(pairs), np.int64)
    return Model(at, np.array([pairs[i] for i in at]), bias)


def _score(shared):
    state = {}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "w" not in state:
            state["w"] = shared.value.dense()
        w, bias = state["w"], shared.value.bias
        for batch in batches:
            data, starts, ends = textkit.view(batch.column("text"))
            total = np.full(batch.num_rows, bias)
            for lo, hi in portions(starts, ends):
                h, low, high = textkit.words(data, starts[lo:hi], ends[lo:hi], textkit.ALNUM)
                seen = []
                for row, at in features(h, low, high):
                    on = w[at] != 0
                    seen.append(row[on] << BITS | at[on])
                both = np.unique(np.concatenate(seen))
                total[lo:hi] += np.bincount(both >> BITS, w[both & ((1 << BITS) - 1)], minlength=hi - lo)
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "toxicity_score"])

    return each


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of docs with toxicity_score, a double from 0 to 1, added.

    A null text counts as empty; whole texts are scored, in portions of bounded size, and a longer text alone. Rows are
    handled one by one: repeated rows and ties get the same score, and an empty table gives an empty one. A column of
    docs that is called toxicity_score is replaced; others may have any names.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("toxicity_score")
    return docs.mapInArrow(_score(shared), and_double(docs.schema, "toxicity_score"))
