"""Threshold curves: ROC, precision-recall, operating points, risk and coverage.

Rows are first counted by score where ties may be merged. Running sums have two levels: inside ranges of the
score, each a partition of its own, and over the ranges' totals, so that no window holds the whole table. A score that fills
ranges alone is cut by the tie's order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranges

TARGETS = (0.0001, 0.001, 0.01, 0.05, 0.1)


def running(df: DataFrame, score: str, sums: list[str], tie: str | None = None) -> DataFrame:
    """df with run_<c> for each c of sums: its sum over the rows of higher scores up to the row itself, equal scores in the order of tie."""
    rows = ranges.parted(df, score, tie, "__part", "__sub")
    total = rows.groupBy("__part", "__sub").agg(*[F.sum(c).alias(f"__sum_{c}") for c in sums])
    above = W.orderBy(F.desc("__part"), "__sub").rowsBetween(W.unboundedPreceding, -1)  # over the ranges only
    total = total.select("__part", "__sub", *[F.coalesce(F.sum(f"__sum_{c}").over(above), F.lit(0)).alias(f"__before_{c}") for c in sums])
    own = W.partitionBy("__part", "__sub").orderBy(F.desc(score), *([tie] if tie else [])).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({f"__run_{c}": F.sum(c).over(own) for c in sums}).join(F.broadcast(total), ["__part", "__sub"])
    return rows.select(*df.columns, *[(F.col(f"__run_{c}") + F.col(f"__before_{c}")).alias(f"run_{c}") for c in sums])


def by_score(df: DataFrame, score: str = "prob", y: str = "y") -> DataFrame:
    """(score, pos, neg, run_pos, run_neg) of each different score."""
    counted = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    return running(counted, "score", ["pos", "neg"])


def roc_auc(df: DataFrame, score: str = "prob", y: str = "y") -> DataFrame:
    """Area under ROC, ties counted half; null with one class."""
    wins = F.sum(F.col("neg") * (F.col("run_pos") - F.col("pos") / 2))
    both = F.sum("pos") * F.sum("neg")
    return by_score(df, score, y).agg(F.round(F.when(both > 0, wins / both), 6).alias("auc"))


def roc_auc_ranks(df: DataFrame, score: str = "prob", y: str = "y") -> DataFrame:
    """The same by average ranks (Mann-Whitney)."""
    rows = by_score(df, score, y)
    p, n = F.sum("pos"), F.sum("neg")
    below = F.col("pos") * (-(F.col("run_pos") + F.col("run_neg")) + (F.col("pos") + F.col("neg") + 1) / 2)
    rank_sum = F.sum(below) + p * (p + n)  # ranks count from the lowest score
    return rows.agg(F.round(F.when(p * n > 0, (rank_sum - p * (p + 1) / 2) / (p * n)), 6).alias("auc"))


def points(df: DataFrame, score: str = "prob", y: str = "y", seq: str = "id") -> DataFrame:
    """A row for each example in descending score (ties in input order): tp and fp so far."""
    rows = df.select(F.col(score).alias("score"), F.col(seq).alias("seq"), F.col(y).cast("long").alias("tp"), (1 - F.col(y)).cast("long").alias("fp"))
    return running(rows, "score", ["tp", "fp"], "seq")


def _with_totals(rows: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("tp").alias("p"), F.sum("fp").alias("n"))))  # one row


def roc_curve(df: DataFrame, score: str = "prob", y: str = "y", seq: str = "id") -> DataFrame:
    rows = _with_totals(points(df, score, y, seq))
    return rows.select("seq", F.round(F.col("run_fp") / F.col("n"), 6).alias("fpr"), F.round(F.col("run_tp") / F.col("p"), 6).alias("tpr"))


def pr_curve(df: DataFrame, score: str = "prob", y: str = "y", seq: str = "id") -> DataFrame:
    rows = _with_totals(points(df, score, y, seq))
    return rows.select("seq", F.round(F.col("run_tp") / F.col("p"), 6).alias("recall"), F.round(F.col("run_tp") / (F.col("run_tp") + F.col("run_fp")), 6).alias("precision"))


def pr_auc(df: DataFrame, score: str = "prob", y: str = "y", seq: str = "id") -> DataFrame:
    """Trapezoids from (0, 1) over the rows in order; the order inside ties matters. A step is 1 / P wide at each positive row.

    The precision of the row before is known from the row's own counts, so no second window is needed.
    """
    rows = points(df, score, y, seq)
    k = F.col("run_tp") + F.col("run_fp")
    now = F.col("run_tp") / k
    before = F.when(k == 1, 1.0).otherwise((F.col("run_tp") - F.col("tp")) / (k - 1))
    return rows.agg(F.round(F.when(F.sum("tp") > 0, F.sum(F.when(F.col("tp") == 1, (now + before) / 2)) / F.sum("tp")), 6).alias("auc"))


def operating_points(df: DataFrame, score: str = "prob", y: str = "y") -> DataFrame:
    """For each threshold: tp, fp, tn, fn, tpr, fpr; and the point above all scores (threshold infinity). Empty with one class."""
    rows = by_score(df, score, y)
    total = rows.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    start = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "threshold double, tp long, fp long")
    rows = rows.select(F.col("score").cast("double").alias("threshold"), F.col("run_pos").alias("tp"), F.col("run_neg").alias("fp")).unionByName(start)
    rows = rows.crossJoin(F.broadcast(total)).where("p > 0 AND n > 0")
    tn, fn = F.col("n") - F.col("fp"), F.col("p") - F.col("tp")
    return rows.select("threshold", "tp", "fp", tn.alias("tn"), fn.alias("fn"), (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), ((F.col("tp") + tn) / (F.col("p") + F.col("n"))).alias("acc"), F.when(2 * F.col("tp") + F.col("fp") + fn > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + fn)).otherwise(0.0).alias("f1"))


def _targets(df: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    return df.withColumn("target", F.explode(F.array(*map(F.lit, targets))))


def tpr_at_fpr(df: DataFrame, targets: tuple[float, ...] = TARGETS, score: str = "prob", y: str = "y") -> DataFrame:
    """For each target the last point, going down the thresholds, whose fpr does not exceed it; nulls with one class."""
    rows = _targets(operating_points(df, score, y), targets).where("fpr <= target")
    best = rows.groupBy("target").agg(F.min_by(F.struct("threshold", "tp", "fp", "tn", "fn", "tpr", "fpr", "acc", "f1"), "threshold").alias("at")).select("target", "at.*")
    whole = df.sparkSession.createDataFrame([(t,) for t in targets], "target double").join(F.broadcast(best), "target", "left")
    return whole.select("target", *[F.round(c, 6).alias(c) if c in ("threshold", "tpr", "fpr", "acc", "f1") else F.col(c) for c in best.columns[1:]])


def tpr_at_fpr_calibration(df: DataFrame, targets: tuple[float, ...] = (0.05, 0.01, 0.001, 0.0001), score: str = "prob", y: str = "y") -> DataFrame:
    """For each target the point of the highest tpr, of those the highest threshold, whose fpr exceeds it by 1e-12 at most."""
    rows = _targets(operating_points(df, score, y), targets).where("fpr <= target + 1e-12")
    best = rows.groupBy("target").agg(F.max(F.struct("tpr", "threshold", "fpr")).alias("at"))
    return best.select("target", F.round("at.threshold", 6).alias("threshold"), F.round("at.tpr", 6).alias("tpr"), F.round("at.fpr", 6).alias("fpr"))


def tpr_at_fpr_simple(df: DataFrame, target: float = 0.01, score: str = "prob", y: str = "y") -> DataFrame:
    return operating_points(df, score, y).where(F.col("fpr") <= target).agg(F.round(F.max("tpr"), 6).alias("tpr"))


def best_threshold(df: DataFrame, mode: str = "acc", score: str = "prob", y: str = "y") -> DataFrame:
    """The threshold of the best acc, f1 or tpr; of equal ones the highest."""
    rows = operating_points(df, score, y).where("threshold < double('infinity')")
    best = rows.agg(F.max(F.struct(F.round(mode, 9).alias("value"), F.col("threshold"))).alias("at"))
    return best.select(F.round("at.threshold", 6).alias("threshold"), F.round("at.value", 6).alias("value"))


def risk_coverage(df: DataFrame, score: str = "prob", y: str = "y", seq: str = "id", threshold: float = 0.5) -> DataFrame:
    """Share of errors among the examples of the highest confidence max(p, 1 - p), as more and more are covered."""
    wrong = ((F.col(score) >= threshold).cast("int") != F.col(y)).cast("long")
    rows = df.select(F.round(F.greatest(F.col(score), 1 - F.col(score)), 9).alias("score"), F.col(seq).alias("seq"), wrong.alias("wrong"), F.lit(1).cast("long").alias("k"))
    rows = running(rows, "score", ["wrong", "k"], "seq")
    total = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(total)).select("seq", F.round(F.col("run_k") / F.col("n"), 6).alias("coverage"), F.round(F.col("run_wrong") / F.col("run_k"), 6).alias("risk"))


def moving_average(df: DataFrame, value: str, order: str, window: int, *groups: str) -> DataFrame:
    """Mean of a row and up to window - 1 rows before it, in each group."""
    own = W.partitionBy(*groups).orderBy(order).rowsBetween(1 - window, 0)
    return df.withColumn("average", F.round(F.avg(value).over(own), 6))
