"""k nearest neighbours by cosine, exactly, from an index of cells.

Vectors are scaled to length one, so that the most similar are the nearest. A bounded sample of the base gives pivots; every base row is
in the cell of its nearest pivot. A query first meets the nearest cells that have k rows together. The distance of its k-th best so far then
rules out, by the triangle inequality, every cell whose pivot is further away than that distance and the cell's radius together; it meets
the other ones in a second round. Cells and queries meet by shuffles, cut into chunks: a chunk of a cell with a group of queries
whose own cells are near each other, so that a base row is sent once for each group that needs its cell. Only pivots and the cells' sizes and
radii are on the driver.

Defined results: rows without a vector, with a null, NaN or infinite entry, or of another length than the base's longest vectors have no part;
a vector of zeros has similarity 0 to all; similarities are rounded to six digits before ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a cell is to have, pivots at most, rows of a chunk of a cell, queries of a group; rows that a task compares at a time.
CELL, PIVOTS, CHUNK, GROUP, ROWS = 512, 1024, 1 << 16, 1 << 16, 2_000
#: Pairs of a group and a cell that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: What rounding to six digits and double precision may hide of a similarity.
SLACK = 2e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


Best = tuple[np.ndarray, np.ndarray, np.ndarray]


def first(old: Best | None, new: Best, k: int) -> Best:
    """The k most similar of each row of (similarity, id, label), of equal ones those of the smallest ids."""
    if new[0].shape[1] > k:  # what is less similar than the k-th cannot be among them
        kth = -np.partition(-new[0], k - 1, axis=1)[:, k - 1 : k]
        width = int((new[0] >= kth).sum(1).max())
        if width < new[0].shape[1]:
            order = np.argsort(-new[0], axis=1, kind="stable")[:, :width]
            new = tuple(np.take_along_axis(x, order, 1) for x in new)
    both = new if old is None else tuple(np.concatenate([a, b], 1) for a, b in zip(old, new, strict=True))
    order = np.lexsort((both[1], -both[0]))[:, :k]
    return tuple(np.take_along_axis(x, order, 1) for x in both)


def usable(vector: Column, size: int) -> Column:
    entry = lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False))  # noqa: E731  NaN is above all
    return vector.isNotNull() & (F.size(vector) == size) & F.forall(vector, entry)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df, written to a folder and read again if there is one."""
    if folder is None:
        return df
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (v @ pivots.T)))


class Cells:
    """The base in cells: rows (cell, id, v, y), and on the driver the pivots, and each cell's rows and radius."""

    def __init__(self, base: DataFrame, key: str = "id", vector: str = "v", label: str = "y", folder: str | None = None):
        self.spark, self.folder = base.sparkSession, folder
        found = base.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("size")).first()
        self.size = max(found.size or 0, 0)
        rows = base.where(usable(F.col(vector), self.size)).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("y"))
        some = rows.where(F.exists("v", lambda c: c != 0)).orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, max(1, found.n // CELL))).select("v").collect()  # PIVOTS at most
        self.pivots = np.unique(unit(np.array([r.v for r in some])), axis=0) if some else np.zeros((0, self.size))
        pivots = self.pivots

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b), ROWS):
                    rows = b.iloc[a : a + ROWS]
                    v = unit(_matrix(rows.v))
                    zero = ~v.any(1)
                    d = _distances(v, pivots) if len(pivots) else np.zeros((len(v), 1))
                    yield rows.assign(cell=np.where(zero, -1, d.argmin(1)), v=list(v), distance=d.min(1))

        kind = rows.schema["id"].dataType.simpleString(), rows.schema["y"].dataType.simpleString()
        self.rows = _kept(rows.mapInPandas(placed, f"id {kind[0]}, v array<double>, y {kind[1]}, cell int, distance double"), folder, "cells")
        stats = {r.cell: r for r in self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}  # a row a pivot
        of = lambda c, name, none: getattr(stats[c], name) if c in stats else none
        self.counts = np.array([of(c, "n", 0) for c in range(len(pivots))], np.int64)
        self.radius = np.array([of(c, "radius", 0.0) for c in range(len(pivots))])
        self.zeros = of(-1, "n", 0)
        self.kinds = kind

    def order(self) -> np.ndarray:
        """Each pivot's place along the direction in which the pivots vary most."""
        centred = self.pivots - self.pivots.mean(0)
        along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0] if len(centred) > 1 else np.zeros(len(centred))
        return np.argsort(np.argsort(along, kind="stable"), kind="stable")

    def met(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, id, similarity, y): the k best of each chunk of a cell that a query (query, group, v, cells) is to meet."""
        chunks = F.array(*[F.lit(max(1, -(-int(n) // CHUNK))) for n in self.counts])
        asked = queries.select("query", "group", "v", F.explode("cells").alias("cell"))
        pairs = asked.select(F.col("group").alias("of"), F.col("cell").alias("needs")).distinct()
        base = self.rows.where("cell >= 0").withColumn("chunk", F.pmod(F.xxhash64("id"), F.get(chunks, F.col("cell")).cast("long")))
        base = base.join(F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs.hint("merge"), F.col("cell") == F.col("needs")).select(F.col("of").alias("group"), "cell", "chunk", "id", "v", "y")
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.get(chunks, F.col("cell")).cast("long") - 1)))
        on = ["group", "cell", "chunk"]

        def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(rows):
                return pd.DataFrame({"query": [], "id": [], "similarity": [], "y": []})
            v, ids, y, out = _matrix(rows.v), rows.id.to_numpy(), rows.y.to_numpy(), []
            for a in range(0, len(queries), ROWS):
                q, held = _matrix(queries.v.iloc[a : a + ROWS]), None
                for b in range(0, len(v), ROWS):
                    sim = np.round(q @ v[b : b + ROWS].T, 6)
                    held = first(held, (sim, np.broadcast_to(ids[b : b + ROWS], sim.shape), np.broadcast_to(y[b : b + ROWS], sim.shape)), k)
                names = np.repeat(queries["query"].iloc[a : a + ROWS].to_numpy(), held[0].shape[1])
                out.append(pd.DataFrame({"query": names, "id": held[1].ravel(), "similarity": held[0].ravel(), "y": held[2].ravel()}))
            return pd.concat(out)

        return asked.groupBy(*on).cogroup(base.groupBy(*on)).applyInPandas(best, f"query {self.query_kind}, id {self.kinds[0]}, similarity double, y {self.kinds[1]}")

    def nearest(self, queries: DataFrame, k: int, key: str = "id", vector: str = "v") -> DataFrame:
        self.query_kind = queries.schema[key].dataType.simpleString()
        schema = f"query {self.query_kind}, id {self.kinds[0]}, similarity double, y {self.kinds[1]}, place int"
        usual = queries.where(usable(F.col(vector), self.size)).select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("v"))
        if not len(self.pivots) and not self.zeros or self.size == 0:
            return self.spark.createDataFrame([], schema)
        parts = []
        if len(self.pivots):
            parts += self._rounds(usual.where(F.exists("v", lambda c: c != 0)), k)
        like_none = lambda q, rows: q.crossJoin(F.broadcast(rows.orderBy("id").limit(k).select("id", F.lit(0.0).alias("similarity"), "y"))).select("query", "id", "similarity", "y")  # noqa: E731  k rows
        parts.append(like_none(usual.where(F.forall("v", lambda c: c == 0)), self.rows))
        if self.zeros:
            parts.append(like_none(usual.where(F.exists("v", lambda c: c != 0)), self.rows.where("cell = -1")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        return out.withColumn("place", place).where(F.col("place") <= k).select("query", "id", "similarity", "y", "place")

    def _rounds(self, queries: DataFrame, k: int) -> list[DataFrame]:
        pivots, counts, radius, place = self.pivots, self.counts, self.radius, self.order()
        groups = max(1, -(-queries.count() // GROUP))

        def first_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b), ROWS):
                    rows = b.iloc[a : a + ROWS]
                    v = unit(_matrix(rows.v))
                    d = _distances(v, pivots)
                    near = np.argsort(d, 1, kind="stable")
                    upto = np.cumsum(counts[near], 1)
                    needed = np.minimum((upto < k).sum(1) + 1, len(pivots))
                    home = place[near[:, 0]]
                    yield pd.DataFrame({"query": rows["query"], "v": list(v), "cells": [c[:n] for c, n in zip(near, needed, strict=True)], "home": home})

        one = queries.mapInPandas(first_round, f"query {self.query_kind}, v array<double>, cells array<int>, home int")
        # Groups are runs of neighbouring homes, of about as many queries each; a home that fills several is cut by the queries' hashes.
        sizes = {r.home: r["count"] for r in one.groupBy("home").count().collect()}  # a row a pivot
        at, ends = 0, {}
        for h in sorted(sizes):
            ends[h] = (at * groups // max(1, sum(sizes.values())), -(-(at + sizes[h]) * groups // max(1, sum(sizes.values()))))
            at += sizes[h]
        low = F.get(F.array(*[F.lit(ends.get(h, (0, 1))[0]) for h in range(len(pivots))]), F.col("home"))
        width = F.get(F.array(*[F.lit(max(1, ends.get(h, (0, 1))[1] - ends.get(h, (0, 1))[0])) for h in range(len(pivots))]), F.col("home"))
        one = _kept(one.withColumn("group", low + F.pmod(F.xxhash64("query"), width)).drop("home"), self.folder, f"asked-{k}")
        found = _kept(self.met(one, k), self.folder, f"found-{k}")
        if len(pivots) == 1:
            return [found]
        rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "id"))
        kth = found.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.col("similarity").alias("kth"))

        def second_round(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for a in range(0, len(b), ROWS):
                    rows = b.iloc[a : a + ROWS]
                    bound = np.sqrt(np.maximum(0.0, 2 - 2 * rows.kth.fillna(-2.0).to_numpy(float)) + 2 * SLACK)
                    reach = (_distances(_matrix(rows.v), pivots) - radius <= bound[:, None] + SLACK) & (counts > 0)
                    for k, seen in enumerate(rows.cells):
                        reach[k, seen] = False
                    yield rows.assign(cells=[np.flatnonzero(r) for r in reach]).drop(columns="kth")

        more = one.join(kth, "query", "left").select("query", "group", "v", "cells", "kth").mapInPandas(second_round, f"query {self.query_kind}, group long, v array<double>, cells array<int>")
        return [found, self.met(_kept(more.where(F.size("cells") > 0), self.folder, f"more-{k}"), k)]


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "id", vector: str = "v", label: str = "y", folder: str | None = None) -> DataFrame:
    """(query, id, similarity, y, place) of the k most similar base rows of each query, ties by id; tables in between are written to a folder if given."""
    return Cells(base, key, vector, label, folder).nearest(queries, k, key, vector)


def votes(found: DataFrame) -> DataFrame:
    """Majority label (a tie is 1) and share of ones of each query."""
    return found.groupBy("query").agg((2 * F.sum("y") >= F.count("*")).cast("int").alias("vote"), F.round(F.avg("y"), 6).alias("prob"))


def sweep(found: DataFrame, truth: DataFrame, most: int) -> DataFrame:
    """Accuracy and mean recall of the vote for each k up to most; the query's prefix sums give all k in one pass."""
    ones = F.sum("y").over(W.partitionBy("query").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    rows = found.where(F.col("place") <= most).select("query", F.col("place").alias("k"), (2 * ones >= F.col("place")).cast("int").alias("vote")).join(truth, "query")
    rec = lambda y: F.sum(((F.col("vote") == y) & (F.col("truth") == y)).cast("int")) / F.greatest(F.sum((F.col("truth") == y).cast("int")), F.lit(1))
    return rows.groupBy("k").agg(F.round(F.avg((F.col("vote") == F.col("truth")).cast("int")), 6).alias("acc"), F.round((rec(0) + rec(1)) / 2, 6).alias("avg_rec"))
