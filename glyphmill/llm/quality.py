"""Operator 9: quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(w . x - theta_k): one weight for each hashed feature of the text, shared by all grades,
and ordered thresholds theta_0 < theta_1 < ... (a first one and the logarithms of the gaps). The model
gives each text its expected grade and the probability of its tail, by which it is selected.

Ratings: 0 if quality is 0, 1 if quality is 1 but the text toxic, 2 if it is neither poor nor toxic. The model
is fitted over a bounded sample (TRAIN_ROWS of the lowest hashed ids) and applied to every whole text.

Defined results: null and empty texts are graded by the thresholds alone; grades that no label has get
thresholds far out; without labels every text has the highest grade and is kept; repeated rows are graded
each; columns of documents with any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .text_features import Features, Sparse, chosen_features, descend, sample, sigmoid

GRADES = 3
#: A text is kept if the probability of a grade of at least TAIL is at least KEEP.
TAIL, KEEP = 1, 0.5
STEPS, L2 = 200, 3e-4


def rating() -> Column:
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)


@dataclass
class Ordinal:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def ordered(cut: np.ndarray) -> np.ndarray:
    """Thresholds of a first one and the logarithms of the gaps."""
    return np.concatenate([cut[:1], cut[0] + np.cumsum(np.exp(np.clip(cut[1:], -20, 20)))])


def gradient(p: np.ndarray, x: Sparse, grade: np.ndarray) -> np.ndarray:
    """Of the mean negative log likelihood with a penalty on the weights; p: weights, first threshold, logarithms of the gaps."""
    m, n = x.width, len(grade)
    edge = np.concatenate([[-np.inf], ordered(p[m:]), [np.inf]])
    f = x.times(p[:m])
    low, high = sigmoid(edge[grade] - f), sigmoid(edge[grade + 1] - f)
    low, high = np.where(grade == 0, 0.0, low), np.where(grade == GRADES - 1, 1.0, high)
    mass = np.maximum(high - low, 1e-12)
    d_low, d_high = low * (1 - low) / mass, high * (1 - high) / mass  # of the log likelihood by the edges
    by_f = (d_high - d_low) / n  # of the loss
    by_theta = np.zeros(GRADES - 1)
    np.add.at(by_theta, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -d_high, 0) / n)
    np.add.at(by_theta, np.maximum(grade - 1, 0), np.where(grade > 0, d_low, 0) / n)
    gaps = np.exp(np.clip(p[m + 1 :], -20, 20)) * np.cumsum(by_theta[:0:-1])[::-1]
    return np.concatenate([x.back(by_f) + L2 * p[:m], [by_theta.sum()], gaps])


def fitted(lists: list[np.ndarray], grade: np.ndarray) -> Ordinal:
    """Maximum likelihood with a small penalty on the weights."""
    n = len(grade)
    if not n:
        return Ordinal(np.empty(0, int), np.empty(0), np.linspace(-41, -40, GRADES - 1))
    above = np.array([np.clip(np.mean(grade > k), 1e-6, 1 - 1e-6) for k in range(GRADES - 1)])
    start = -np.log(above / (1 - above))
    start = np.maximum.accumulate(start + 1e-3 * np.arange(GRADES - 1))
    chosen = chosen_features(lists, grade) if np.var(grade) else np.empty(0, int)
    x = Sparse(lists, chosen)
    m = x.width

    by_row = x.times(np.ones(m)) + 1
    curve = np.concatenate([x.back(by_row) / (4 * n) + L2, np.full(GRADES - 1, by_row.mean() / 4 + 0.5)])
    p = descend(lambda p: gradient(p, x, grade), np.concatenate([np.zeros(m), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))]), STEPS, 1 / curve)
    return Ordinal(chosen, p[:m], ordered(p[m:]))


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> Ordinal:
    lists, targets, _ = sample(docs, labels, {"grade": rating()}, doc, text)
    return fitted(lists, targets["grade"])


def graded(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """docs with __above_0, __above_1, ... (with underscores at the end where docs has them): the probabilities of a higher grade than 0, 1, ..."""
    schema = docs.select("*", *[F.lit(0.0).alias(n) for n in common.unused(docs, *[f"__above_{k}" for k in range(GRADES - 1)])]).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        features = Features({int(f): c for c, f in enumerate(model.features)})
        for batch in common.batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total = np.array([model.weights[list(features.of(t))].sum() if len(model.weights) else 0.0 for t in texts])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(sigmoid(total - t)) for t in model.thresholds)], names=schema.names)

    return docs.select("*", common.text_or_empty(text).alias(common.unused(docs, "__text")[0])).mapInArrow(run, schema)


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = graded(docs, train(docs, common.table(spark, sf_dir, "labels")))
    tail = F.col(f"__above_{TAIL - 1}")
    return out.select("doc_id", sum(F.col(f"__above_{k}") for k in range(GRADES - 1)).alias("expected_grade"), tail.alias("p_tail"), (tail >= KEEP).alias("keep"))
