"""Ranges of a numeric column, so that windows over a whole table's order become windows over parts of it."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges at least; there are as many as shuffle partitions if those are more.
LEAST = 64


def cuts(df: DataFrame, column: str) -> list[float]:
    """Quantiles of a column in ascending order, for as many ranges as the shuffle has partitions; one that occurs twice holds a range's rows alone."""
    n = max(LEAST, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.select(F.percentile_approx(F.col(column).cast("double"), [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    return sorted(x for x in found if math.isfinite(x))


def ranged(df: DataFrame, column: str, at: list[float], name: str) -> DataFrame:
    """df with the number of each row's range, from 0 in ascending order; nulls and NaN come last."""
    if not at:  # an empty table, or one without a finite value
        return df.withColumn(name, F.lit(0))
    splits = [-math.inf, *sorted(set(at)), math.inf]
    number, out = "__number", "__bucket"
    rows = Bucketizer(splits=splits, inputCol=number, outputCol=out, handleInvalid="keep").transform(df.withColumn(number, F.col(column).cast("double")))
    return rows.withColumn(name, F.col(out).cast("int")).drop(number, out)


def parted(df: DataFrame, column: str, tie: str | None, part: str, sub: str) -> DataFrame:
    """df with ranges of a column, and within a value that fills ranges of its own, ranges of the tie's column; 0 for all others."""
    own = cuts(df, column)
    hot = sorted({a for a, b in zip(own, own[1:]) if a == b})
    rows = ranged(df, column, own + [math.nextafter(x, math.inf) for x in hot], part)
    if not hot or tie is None or dict(df.dtypes)[tie] in ("string", "binary"):
        return rows.withColumn(sub, F.lit(0))
    return ranged(rows, tie, cuts(df, tie), sub).withColumn(sub, F.when(F.col(column).cast("double").isin(hot), F.col(sub)).otherwise(0))
