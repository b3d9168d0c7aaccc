"""Operator 13: whitening of embeddings by moments that merge (Chan).

Every partition of the fit list computes its count, its exact sums, its mean and its scatter around that mean; two such states
merge by Chan's pairwise formula, in a treeReduce, so that the driver meets few of them, each of the square of the dimensions.
The eigenvectors are found on the driver. A second pass over the fit list merges the moments of the whitened values in the same
way and says how far their covariance is from the identity.

Defined results: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped; of the others the fit list has each
different vector once, so repeated rows do not weigh and each has result rows of its own; rows without an id are kept. Vectors of
another length than the commonest (of ties the longest) have null results and no part in the fit. A component without variance
(one vector alone, rank too low) has a null in whitened and 0 in explained, and no part in the identity; empty tables, and tables
of empty vectors, give an empty result. Entries are read to a 256th; beyond a long they count as the largest long, and a deviation
beyond a long is an error. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Components of the result.
COMPONENTS = 4
#: States that one task of the reduction merges, about.
FAN_IN = 64


class Moments(NamedTuple):
    """Count, exact sums, mean and scatter around the mean of some vectors."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x; sums are exact for whole numbers (by halves of 32 bits), and plain sums of other numbers."""
    if np.issubdtype(x.dtype, np.integer):
        sums = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
    else:
        sums = x.sum(0).tolist()
    mean = np.array([s / len(x) for s in sums])
    centred = x - mean
    return Moments(len(x), sums, mean, centred.T @ centred)


def merged(a: Moments, b: Moments) -> Moments:
    """Chan: the scatters add up, and the distance of the means adds its own."""
    n, apart = a.n + b.n, b.mean - a.mean
    sums = [p + q for p, q in zip(a.sums, b.sums, strict=True)]
    return Moments(n, sums, np.array([s / n for s in sums]), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def rows_of(vectors: pa.Array, dims: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def reduced(vectors: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """The moments of a table of one column of arrays of dims long numbers, or of what `of` makes of them."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                own = moments(of(rows_of(batch.column(0), dims)))
                state = own if state is None else merged(state, own)
        if state is not None:
            yield pa.record_batch([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = vectors.mapInArrow(partial, "state binary").rdd
    depth = max(2, math.ceil(math.log(max(2, states.getNumPartitions()), FAN_IN)))
    return states.map(lambda r: pickle.loads(bytes(r.state))).treeReduce(merged, depth)


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    mean: np.ndarray
    #: A column for each component, its eigenvalue, and the trace of the covariance.
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """x - mean on the components that have variance, over its root."""
        with_variance = self.values > 0
        return (x - self.mean) @ (self.vectors[:, with_variance] / np.sqrt(self.values[with_variance]))

    def deviations(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum over the dimensions of (n x - sum)^2, in whole numbers."""
        most = self.n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, self.sums), default=0)
        if most * most * x.shape[1] < 1 << 63:
            return ((x * self.n - np.array(self.sums, np.int64)) ** 2).sum(1)
        return ((x.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1).tolist()


def decomposed(m: Moments, k: int = COMPONENTS) -> Whitening:
    cov = m.scatter / m.n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    values = np.where(values > len(cov) * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    sign = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return Whitening(m.n, m.sums, m.mean, vectors * sign, values, float(np.trace(cov)))


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest entry, without sign, of the whitened fit list's covariance less the identity."""
    if not (model.values > 0).any():
        return None
    m = reduced(fit, len(model.mean), model.apply)
    return float(np.abs(m.scatter / m.n - np.eye(len(m.mean))).max())


def units(embedding: Column) -> Column:
    """The entries of a vector, in whole 256ths."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * 256).cast("long"))


def usable(embedding: Column) -> Column:
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all
    return embedding.isNotNull() & F.forall(embedding, entry)


def whiten(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each usable row and component: key, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = rows.where(usable(F.col(embedding))).select(F.col(key).alias("key"), units(F.col(embedding)).alias("x"))
    common_length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common_length is None or common_length.d == 0:
        return spark.createDataFrame([], schema)
    dims = common_length.d
    fit = common.durable(x.where(F.size("x") == dims).select("x").distinct(), "fit")
    model = decomposed(reduced(fit, dims))
    error = identity_error(fit, model)
    common.remove(fit)
    return x.withColumn("x", F.when(F.size("x") == dims, F.col("x"))).mapInArrow(lambda batches: projected(batches, model, error, key), schema)


def projected(given: Iterable[pa.RecordBatch], model: Whitening, error: float | None, key: str) -> Iterator[pa.RecordBatch]:
    k, with_variance = len(model.values), model.values > 0
    for batch in common.batches(given):
        x = batch.column(1)
        there = np.asarray(x.is_valid())
        at = np.full(batch.num_rows, -1)
        at[there] = np.arange(there.sum())
        rows = rows_of(x.drop_null(), len(model.mean))
        values = np.full((len(rows), k), np.nan)
        values[:, with_variance] = model.apply(rows)
        place = np.repeat(at, k)
        place = pa.array(np.where(place < 0, 0, place), mask=place < 0)
        component = np.tile(np.arange(k), batch.num_rows)
        whitened = pa.array(values.ravel(), mask=np.isnan(values.ravel())) if len(rows) else pa.array([], pa.float64())
        where = pa.array(np.repeat(at, k) * k + component, mask=np.repeat(~there, k))
        whole = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(len(component), int), mask=np.repeat(~there, k)))
        yield pa.record_batch(
            {
                key: batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), k))),
                "component": pa.array(component + 1, pa.int32()),
                "n": whole(model.n, pa.int64()),
                "deviation": pa.array(model.deviations(rows), pa.int64()).take(place),
                "whitened": whitened.take(where),
                "explained": pa.array((model.values / model.trace if model.trace > 0 else model.values * 0.0)[component], mask=np.repeat(~there, k)),
                "identity_error": whole(error, pa.float64()),
            }
        )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
