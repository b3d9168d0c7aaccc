"""Operator 4: toxicity by a chain of linear classifiers.

The categories are predicted one after the other: every category's logistic model sees the hashed words of
the text and the probabilities of the categories before it. For training, those probabilities are
out-of-fold predictions, so that later models meet earlier ones as they will be on new text.

Models are fitted on the driver over a bounded sample of labelled documents (TRAIN_ROWS of the lowest hashed
ids) and scored over every whole text. Categories here: junk (quality is 0), then toxic.

Defined results: null and empty texts are scored by the intercepts; without labels, or with labels of one
class, a category's probability is that class's share (0 without any); repeated rows are scored each;
columns of documents with any name are kept.
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

#: A document is toxic from this probability on.
THRESHOLD = 0.5
FOLDS, STEPS, L2 = 3, 300, 1e-4


def categories() -> dict[str, Column]:
    """The chain, in order."""
    return {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")}


@dataclass
class Linear:
    """A logistic model over chosen features and the probabilities of earlier categories."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float

    def probability(self, texts: Sparse, before: np.ndarray) -> np.ndarray:
        return sigmoid(texts.times(self.weights) + before @ self.earlier + self.bias)


def gradient(p: np.ndarray, x: Sparse, before: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mean logistic loss with a penalty on all but the bias; p: weights of the features, of the earlier probabilities, bias."""
    m = x.width
    error = (sigmoid(x.times(p[:m]) + before @ p[m:-1] + p[-1]) - y) / len(y)
    return np.concatenate([x.back(error) + L2 * p[:m], before.T @ error + L2 * p[m:-1], [error.sum()]])


def fitted(lists: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    n, k = len(y), before.shape[1]
    share = float(np.mean(y)) if n else 0.0
    if share in (0.0, 1.0):
        return Linear(np.empty(0, int), np.empty(0), np.zeros(k), -40.0 if share == 0 else 40.0)
    chosen = chosen_features(lists, y)
    x = Sparse(lists, chosen)
    m = x.width

    # The sums of |features| by row and by column bound the curvature of each coordinate.
    by_row = x.times(np.ones(m)) + before.sum(1) + 1
    curve = np.concatenate([x.back(by_row), before.T @ by_row, [by_row.sum()]]) / (4 * n) + L2
    p = descend(lambda p: gradient(p, x, before, y), np.concatenate([np.zeros(m + k), [np.log(share / (1 - share))]]), STEPS, 1 / curve)
    return Linear(chosen, p[:m], p[m : m + k], float(p[-1]))


def chain(lists: list[np.ndarray], targets: dict[str, np.ndarray], order: np.ndarray) -> dict[str, Linear]:
    """A model per category; the earlier probabilities that it learns from are out of fold."""
    fold = np.abs(order) % FOLDS
    before = np.zeros((len(order), 0))
    out: dict[str, Linear] = {}
    for name, y in targets.items():
        out[name] = fitted(lists, before, y)
        honest = np.zeros(len(order))
        for f in range(FOLDS):
            inside = fold == f
            model = fitted([x for x, own in zip(lists, inside, strict=True) if not own], before[~inside], y[~inside])
            honest[inside] = model.probability(Sparse((x for x, own in zip(lists, inside, strict=True) if own), model.features), before[inside])
        before = np.concatenate([before, honest[:, None]], 1)
    return out


def train(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> dict[str, Linear]:
    models = chain(*sample(docs, labels, categories(), doc, text))
    pa.default_memory_pool().release_unused()
    return models


def score_names(docs: DataFrame, models: dict[str, Linear]) -> list[str]:
    """The columns that scored() adds: __p_<category>, with underscores at the end where docs has that name."""
    return common.unused(docs, *[f"__p_{n}" for n in models])


def scored(docs: DataFrame, models: dict[str, Linear], text: str = "text") -> DataFrame:
    """docs with a column of probabilities for each model, named by score_names()."""
    schema = docs.select("*", *[F.lit(0.0).alias(n) for n in score_names(docs, models)]).schema
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = list(sent.value.values())
        chosen = np.unique(np.concatenate([m.features for m in models]))
        features = Features({int(f): c for c, f in enumerate(chosen)})
        weights = np.zeros((len(models), len(chosen)))
        for k, m in enumerate(models):
            weights[k, np.searchsorted(chosen, m.features)] = m.weights
        for batch in common.batches(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            totals = np.array([weights[:, list(features.of(t))].sum(1) for t in texts]).reshape(len(texts), len(models))
            before = np.zeros((len(texts), 0))
            for k, model in enumerate(models):
                p = sigmoid(totals[:, k] + before @ model.earlier + model.bias)
                before = np.concatenate([before, p[:, None]], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(before[:, k]) for k in range(len(models)))], names=schema.names)

    return docs.select("*", common.text_or_empty(text).alias(common.unused(docs, "__text")[0])).mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that the chain finds toxic. known: the documents that labels speak of, docs itself unless given."""
    models = train(docs if known is None else known, labels, doc, text)
    toxic = score_names(docs, models)[list(models).index("toxic")]
    return scored(docs, models, text).where(F.col(toxic) < THRESHOLD).select([F.col(f"`{c}`") for c in docs.columns])


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.col("__p_junk").alias("p_junk"), F.col("__p_toxic").alias("p_toxic"), (F.col("__p_toxic") >= THRESHOLD).alias("toxic"))
