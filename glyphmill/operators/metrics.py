"""Effectiveness and calibration of scored examples: confusion counts, group metrics, bins.

A scored table has a label y (0 human, 1 machine), a probability prob, and group columns. Each function is one
aggregation over it; group metrics of several columns take one pass with grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BINS = 10


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("long"))


def confusion(prob: str = "prob", y: str = "y", threshold: Column | float = 0.5) -> dict[str, Column]:
    """Aggregates tp, fp, tn, fn at a threshold; prob >= threshold is predicted 1."""
    up, one = F.col(prob) >= threshold, F.col(y) == 1
    return {"tp": _count(up & one), "fp": _count(up & ~one), "tn": _count(~up & ~one), "fn": _count(~up & one)}


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0, rounded."""
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    return {"acc": ratio(tp + tn, tp + fp + tn + fn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(rates(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def basic_stats(df: DataFrame, threshold: float = 0.5, prob: str = "prob", y: str = "y") -> DataFrame:
    """One row: confusion, rates, and mean, least and largest probability."""
    spread = {"n": F.count("*"), "prob_mean": F.round(F.avg(prob), 6), "prob_min": F.round(F.min(prob), 6), "prob_max": F.round(F.max(prob), 6)}
    return with_rates(df.agg(*_named(spread), *_named(confusion(prob, y, threshold))))


def threshold_table(df: DataFrame, thresholds: list[float], prob: str = "prob", y: str = "y") -> DataFrame:
    """The same at several thresholds, in one pass; thresholds closer than 1e-9 to an earlier one are left out."""
    kept: list[float] = []
    for t in thresholds:
        if all(abs(t - k) >= 1e-9 for k in kept):
            kept.append(t)
    rows = df.select(y, prob, F.explode(F.array(*map(F.lit, kept))).alias("threshold"))
    return with_rates(rows.groupBy("threshold").agg(*_named(confusion(prob, y, F.col("threshold")))))


def by_group(df: DataFrame, column: str, threshold: float = 0.5, exclude: tuple[str, ...] = (), include: Column | None = None, prob: str = "prob", y: str = "y") -> DataFrame:
    """Metrics of each value of a column that is not blank or excluded (in any case)."""
    rows = df if include is None else df.where(include)
    rows = rows.where(F.trim(column) != "")
    if exclude:
        rows = rows.where(~F.lower(F.trim(column)).isin(*map(str.lower, exclude)))
    return with_rates(rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"), *_named(confusion(prob, y, threshold))))


def all_groups(df: DataFrame, columns: list[str], threshold: float = 0.5, prob: str = "prob", y: str = "y") -> DataFrame:
    """Metrics of each value of each column, with one scan and one exchange."""
    sets = [[F.col(c)] for c in columns]
    grouped = df.groupingSets(sets, *columns).agg(F.grouping_id(*columns).alias("__set"), F.count("*").alias("n"), *_named(confusion(prob, y, threshold)))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - k)) for k, c in enumerate(columns)}
    dimension = F.coalesce(*[F.when(F.col("__set") == b, F.lit(c)) for c, b in bits.items()])
    return with_rates(grouped.select(dimension.alias("dimension"), F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n", "tp", "fp", "tn", "fn").where("value IS NOT NULL"))


def class_recalls(df: DataFrame, threshold: float = 0.5, prob: str = "prob", y: str = "y") -> DataFrame:
    """Recall of either class, their mean, and the rates."""
    out = df.agg(*_named(confusion(prob, y, threshold)))
    out = out.withColumns({"human_rec": ratio(F.col("tn"), F.col("tn") + F.col("fp")), "machine_rec": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return with_rates(out.withColumn("avg_rec", F.round((F.col("human_rec") + F.col("machine_rec")) / 2, 6)))


def reliability_bins(df: DataFrame, bins: int = BINS, prob: str = "prob", y: str = "y") -> DataFrame:
    """Bins of equal width, the last closed; empty ones are there with 0 rows."""
    spark = df.sparkSession
    counted = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    whole = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = whole.join(F.broadcast(counted), "bin", "left")
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), value(F.col("conf")).alias("conf"), value(F.col("acc")).alias("acc"), value(F.abs(F.col("acc") - F.col("conf"))).alias("gap"))


def ece_brier(df: DataFrame, bins: int = BINS, prob: str = "prob", y: str = "y") -> DataFrame:
    """Expected calibration error and Brier score from the sums of each bin."""
    part = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).alias("bin")).agg(F.count("*").alias("n"), F.sum(prob).alias("p"), F.sum(y).alias("y"), F.sum(F.pow(F.col(prob) - F.col(y), 2)).alias("sq"))
    return part.agg(F.sum("n").alias("n"), F.round(F.sum(F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def runs(df: DataFrame, run: str, values: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one run), least and largest of each metric over runs."""
    parts = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    rows = df.select(run, parts.alias("m")).select("m.metric", "m.value").where("value IS NOT NULL AND NOT isnan(value)")
    sd = F.when(F.count("*") > 1, F.stddev_samp("value")).otherwise(0.0)
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(sd, 6).alias("std"), F.round(F.min("value"), 6).alias("min"), F.round(F.max("value"), 6).alias("max"))


def moments(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation for standardising; a deviation under 1e-12 counts as 1."""
    sd = F.stddev_pop(column)
    return df.agg(F.count(column).alias("n"), F.round(F.avg(column), 6).alias("mean"), F.round(F.when(sd < 1e-12, 1.0).otherwise(sd), 6).alias("std"))
