"""Hashed text features and the bounded training sample that the linear text models share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Hash space of the features, as a power of two.
BITS = 20
#: Labelled documents a model is fitted on at most: those of the lowest hashed ids.
TRAIN_ROWS = 10_000
#: A model keeps at most so many features, found in at least so many documents, with at least this z score.
MOST, LEAST_DOCS, LEAST_Z = 4096, 3, 3.5

#: Rows that the driver looks at at once while it fits.
ROWS = 500

#: Lengths of the beginnings of words that are features as well.
BEGINNINGS = (4, 5, 6)

_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+")


def hashed(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode()) >> (64 - BITS)


def chunk_features(chunk: str) -> tuple[int, ...]:
    """Features of a run of text without white space: its words, their beginnings, its runs of symbols, and whether it is in capitals."""
    tokens = _TOKENS.findall(chunk.lower())
    found = [hashed(t) for t in tokens] + [hashed(f"{t[:k]}\t") for t in tokens for k in BEGINNINGS if len(t) > k]
    if len(chunk) > 3 and chunk.isupper():
        found.append(hashed("\tcapitals"))
    return tuple(found)


class Features(dict):
    """Features of chunks; bounded, as it starts anew when full. chosen maps features to columns of a model."""

    def __init__(self, chosen: dict[int, int] | None = None, most: int = 150_000):
        super().__init__()
        self.chosen, self.most = chosen, most

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        found = chunk_features(chunk)
        if self.chosen is not None:
            found = tuple(c for f in found if (c := self.chosen.get(f)) is not None)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = found
        return found

    def of(self, text: str) -> set[int]:
        """The features of a whole text, each once."""
        return set().union(*map(self.__getitem__, set(text.split())))


def sample(docs: DataFrame, labels: DataFrame, targets: dict[str, Column], doc: str, text: str) -> tuple[list[np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """Features, targets and ids' hashes of at most TRAIN_ROWS labelled documents. Labels of an id that is repeated are averaged and rounded."""
    told = labels.groupBy(F.col("doc_id").alias("__id")).agg(*[F.round(F.avg(c)).cast("int").alias(n) for n, c in targets.items()]).dropna()
    told = told.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(TRAIN_ROWS)
    rows = docs.select(F.col(doc).alias("__id"), common.text_or_empty(text).alias("__text")).join(F.broadcast(told), "__id")
    names = list(targets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in common.batches(batches):
            found = [sorted(features.of(t)) for t in batch.column(batch.schema.get_field_index("__text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *(batch.column(batch.schema.get_field_index(n)) for n in [*names, "__order"])], names=["f", *names, "o"])

    made = rows.mapInArrow(run, "f array<int>, " + "".join(f"`{n}` int, " for n in names) + "o long")
    got = made.orderBy("o", F.xxhash64("f")).limit(TRAIN_ROWS).toArrow()  # an id may have many rows
    flat, lists = got["f"].combine_chunks(), []
    if len(flat):
        values, at = flat.values.to_numpy(), flat.offsets.to_numpy()
        lists = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return lists, {n: got[n].to_numpy() for n in names}, got["o"].to_numpy()


class Sparse:
    """Rows of binary features over chosen columns, in blocks of rows: what is made for a block is all that is made at once."""

    def __init__(self, lists: Iterable[np.ndarray], chosen: np.ndarray):
        self.blocks, self.n, self.width = [], 0, len(chosen)
        for block in batched(lists, ROWS):
            hits = []
            for x in block:
                at = np.searchsorted(chosen, x)
                at[at == len(chosen)] = 0
                hits.append((at[chosen[at] == x] if len(chosen) else at[:0]).astype(np.int32))
            rows = np.repeat(np.arange(len(block), dtype=np.int32), [len(x) for x in hits])
            self.blocks.append((self.n, self.n + len(block), rows, np.concatenate(hits)))
            self.n += len(block)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(np.bincount(rows, weights[cols], b - a) for a, b, rows, cols in self.blocks)])

    def back(self, errors: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b, rows, cols in self.blocks:
            out += np.bincount(cols, errors[a:b][rows], self.width)
        return out


def chosen_features(lists: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """The features whose documents' mean target is farthest from the mean, in standard errors."""
    size = 1 << BITS
    count, total = np.zeros(size, np.int64), np.zeros(size)
    for k in range(0, len(lists), ROWS):
        block = lists[k : k + ROWS]
        flat = np.concatenate(block)
        np.add.at(count, flat, 1)
        np.add.at(total, flat, np.repeat(target[k : k + ROWS].astype(float), [len(x) for x in block]))
    mean, var = float(np.mean(target)), float(np.var(target))
    ok = np.flatnonzero(count >= LEAST_DOCS)
    z = np.abs(total[ok] - count[ok] * mean) / np.sqrt(count[ok] * max(var, 1e-9))
    ok, z = ok[z >= LEAST_Z], z[z >= LEAST_Z]
    return np.sort(ok[np.argsort(-z, kind="stable")[:MOST]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def descend(gradient, start: np.ndarray, steps: int, step_size: np.ndarray) -> np.ndarray:
    """Accelerated gradient descent with fixed step sizes."""
    x, ahead, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        new = ahead - step_size * gradient(ahead)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - x)
        x = new
    return x
