"""Bootstrap intervals of accuracy, F1, AUROC and AUPR, from Poisson weights of cells.

Rows of one score and label are one cell. A cell of n rows weighs Poisson(n) in a replicate, the sum of n rows' own weights, so that work
grows with the different scores, not with the rows. Draws come from digests of the cell's smallest id, cut into five draws each, so they are the
same on any partitioning. All replicates go together: cells are dealt to ranges of the score, each range gives its sums for every
replicate, and then, with the sums of the ranges above it, its part of both areas. The driver gathers a few numbers for each range
and replicate.

Defined results: rows whose score or label is null or not finite are left out; replicates that miss a class have no AUROC, those without
positives no AUPR; what no replicate has is null, as all is without rows.
"""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.normalize import finite
from . import ranges

ITERATIONS = 500
#: Powers of two up to which a Poisson table is exact; draws of larger ones follow the normal distribution of the same mean and variance.
EXACT_BITS = 10
#: Cells whose weights are held at once; harmonic numbers that are summed, not approximated.
CELLS, HARMONIC = 1000, 1 << 16
_DRAWS = 5


@cache
def poisson_table(bit: int) -> np.ndarray:
    """Distribution function of Poisson(2^bit) at 0, 1, 2 ..., until it is 1 but for 2^-40."""
    mean = float(1 << bit)
    out, total, k = [], 0.0, 0
    while total < 1 - 2.0**-40 or k < mean:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 1 else math.exp(-1.0) / math.factorial(k)
        out.append(total)
        k += 1
    return np.array(out)


@cache
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    z = np.linspace(-8, 8, 1 << 14)
    return np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z]), z


def poisson(u: np.ndarray, bit: int) -> np.ndarray:
    """Draws of Poisson(2^bit) from uniform numbers."""
    if bit <= EXACT_BITS:
        return np.searchsorted(poisson_table(bit), u, side="right")
    at, z = _normal_table()
    return np.rint((1 << bit) + math.sqrt(1 << bit) * np.interp(u, at, z)).astype(np.int64)


def uniforms(keys: list, bit: int, iterations: int, seed: int) -> np.ndarray:
    """A row for each key, a column for each replicate."""
    blocks = -(-iterations // _DRAWS)
    raw = b"".join(hashlib.sha1(f"{seed}:{b}:{k}:{bit}".encode()).digest() for k in keys for b in range(blocks))
    return np.frombuffer(raw, ">u4").reshape(len(keys), -1)[:, :iterations] / 4294967296.0


def weights(keys: np.ndarray, n: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """Of cells by replicates: sums of Poisson draws for the powers of two that make up the cell's rows."""
    out = np.zeros((len(n), iterations), np.int64)
    for bit in range(int(n.max(initial=0)).bit_length()):
        has = np.flatnonzero(n >> bit & 1)
        if len(has):
            out[has] += poisson(uniforms([keys[k] for k in has], bit, iterations, seed), bit)
    return out


def harmonic(n: np.ndarray) -> np.ndarray:
    """1 + 1/2 + ... + 1/n, 0 for n below 1."""
    table = _harmonic_table()
    x = np.maximum(n, HARMONIC).astype(float)
    far = np.log(x) + np.euler_gamma + 1 / (2 * x) - 1 / (12 * x * x)
    return np.where(n < HARMONIC, table[np.clip(n, 0, HARMONIC - 1)], far)


@cache
def _harmonic_table() -> np.ndarray:
    return np.append(0.0, np.cumsum(1.0 / np.arange(1, HARMONIC)))


def precision_area(tp: np.ndarray, fp: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the mean precisions before and after each of w further positives, after tp and fp; the precision before all rows is 1.

    (tp + j) / (k + j) is 1 - fp / (k + j), so the sum over j is one of harmonic numbers.
    """
    k = tp + fp
    after = w - fp * (harmonic(k + w) - harmonic(k))
    before = w - fp * (harmonic(k + w - 1) - harmonic(k - 1))
    return (after + before) / 2


def cells(df: DataFrame, id_column: str, prob: str, y: str) -> DataFrame:
    """(score, y, n, k): rows by score and label, and the smallest id of each."""
    rows = df.where(finite(F.col(prob)) & F.col(y).isNotNull())
    return rows.groupBy(F.col(prob).cast("double").alias("score"), F.col(y).cast("int").alias("y")).agg(F.count("*").alias("n"), F.min(id_column).cast("string").alias("k"), F.min(id_column).alias("first"))


def replicates(df: DataFrame, iterations: int = ITERATIONS, seed: int = rng.SEED, threshold: float = 0.5, id_column: str = "id", prob: str = "prob", y: str = "y") -> dict[str, np.ndarray]:
    """acc, f1, auroc and aupr of every replicate; NaN where a replicate has none."""
    counted = cells(df, id_column, prob, y)
    rows = ranges.ranged(counted, "score", ranges.cuts(counted, "score"), "part").select("part", "score", "y", "n", "k", "first")

    def blocks(part: pd.DataFrame):
        part = part.sort_values(["score", "first"], ascending=[False, True], kind="stable")
        for a in range(0, len(part), CELLS):
            some = part.iloc[a : a + CELLS]
            yield some, weights(some["k"].to_numpy(), some["n"].to_numpy(), iterations, seed)

    def sums(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((4, iterations), np.int64)
        for some, w in blocks(part):
            up, one = (some["score"] >= threshold).to_numpy(), (some["y"] == 1).to_numpy()
            for k, of in enumerate((up & one, up & ~one, ~up & ~one, ~up & one)):
                out[k] += w[of].sum(0)
        return pd.DataFrame({"part": [part["part"].iloc[0]], **{c: [v] for c, v in zip(("tp", "fp", "tn", "fn"), out, strict=True)}})

    got = rows.groupBy("part").applyInPandas(sums, "part int, tp array<long>, fp array<long>, tn array<long>, fn array<long>").collect()
    got.sort(key=lambda r: -r.part)
    if not got:
        return {m: np.full(iterations, np.nan) for m in ("acc", "f1", "auroc", "aupr")}
    tp, fp, tn, fn = (np.array([r[c] for r in got]) for c in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, fp + tn
    above = {r.part: (p, n) for r, p, n in zip(got, np.cumsum(pos, 0) - pos, np.cumsum(neg, 0) - neg, strict=True)}
    sent = df.sparkSession.sparkContext.broadcast(above)  # two numbers for each range and replicate

    def areas(part: pd.DataFrame) -> pd.DataFrame:
        p, n = (x.copy() for x in sent.value[int(part["part"].iloc[0])])
        wins, area = np.zeros(iterations), np.zeros(iterations)
        at, tied = None, np.zeros((2, iterations), np.int64)  # weights of the score at hand
        for some, w in blocks(part):
            for score, one, own in zip(some["score"].to_numpy(), (some["y"] == 1).to_numpy(), w, strict=True):
                if score != at:
                    at, tied = score, np.zeros((2, iterations), np.int64)
                if one:
                    area += precision_area(p, n, own)
                    wins += own * tied[1] / 2
                    p, tied[0] = p + own, own
                else:
                    wins += own * (p - tied[0]) + own * tied[0] / 2
                    n, tied[1] = n + own, own
        return pd.DataFrame({"part": [part["part"].iloc[0]], "wins": [wins], "area": [area]})

    told = sorted(rows.groupBy("part").applyInPandas(areas, "part int, wins array<double>, area array<double>").collect(), key=lambda r: -r.part)
    sent.unpersist()
    tp, fp, tn, fn = (x.sum(0) for x in (tp, fp, tn, fn))
    share = lambda a, b, none: np.divide(a, b, out=np.full(iterations, none, float), where=b > 0)
    both = ((tp + fn) * (fp + tn)).astype(float)
    return {
        "acc": share(tp + tn, tp + fp + tn + fn, np.nan),
        "f1": share(2 * tp, 2 * tp + fp + fn, 0.0),
        "auroc": share(np.sum([r.wins for r in told], 0), both, np.nan),
        "aupr": share(np.sum([r.area for r in told], 0), tp + fn, np.nan),
    }


def intervals(df: DataFrame, iterations: int = ITERATIONS, seed: int = rng.SEED, threshold: float = 0.5, id_column: str = "id", prob: str = "prob", y: str = "y") -> DataFrame:
    """One row: mean, 2.5th and 97.5th percentile (m_mean, m_lo, m_hi) of each metric over the replicates that have it."""
    out = {}
    for name, values in replicates(df, iterations, seed, threshold, id_column, prob, y).items():
        values = np.sort(values[~np.isnan(values)])
        at = lambda q: float(round(values[round(q / 100 * (len(values) - 1))], 6)) if len(values) else None  # noqa: B023, E731
        out |= {f"{name}_mean": float(round(values.mean(), 6)) if len(values) else None, f"{name}_lo": at(2.5), f"{name}_hi": at(97.5)}
    return df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{c} double" for c in out))
