"""Sampling, splitting, de-duplication and set operations by keyed hashes: the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng


def _order(key: Column, seed: int) -> list[Column]:
    return [rng.digest(seed, key), key]


def exact(df: DataFrame, key: str, k: int, seed: int = rng.SEED) -> DataFrame:
    """k rows, in hashed order; all of them if there are no more. A top-k: each task keeps k rows at most."""
    return df.orderBy(*_order(F.col(key), seed)).limit(k)


def keep_order(df: DataFrame, key: str, k: int, seed: int = rng.SEED) -> DataFrame:
    """The same rows in the order of their key."""
    return exact(df, key, k, seed).orderBy(key)


def balanced(df: DataFrame, key: str, label: str, k: int, seed: int = rng.SEED) -> DataFrame:
    """min(k, size of the smallest class) rows of every class; if there is one class only, 2 k of it. Rows without a label are of no class."""
    rows = df.where(F.col(label).isNotNull())
    sizes = rows.groupBy(label).count().agg(F.count("*").alias("classes"), F.min("count").alias("least")).first()
    if sizes.classes < 2:
        return exact(rows, key, 2 * k, seed)
    return ranked(rows, _order(F.col(key), seed), "__rank", label).where(F.col("__rank") <= min(k, sizes.least)).drop("__rank")


def quotas(n: int, weights: tuple[float, ...] = (8, 1, 1)) -> list[int]:
    """Whole numbers that add up to n, by largest remainder; ties go to the larger weight, then the earlier part."""
    shares = [n * w / sum(weights) for w in weights]
    whole = [math.floor(s) for s in shares]
    order = sorted(range(len(weights)), key=lambda i: (-(shares[i] - whole[i]), -weights[i], i))
    for i in order[: n - sum(whole)]:
        whole[i] += 1
    return whole


def quota_table(df: DataFrame, by: str, weights: tuple[int, ...] = (8, 1, 1), names: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """(by, n, and a column for each name): quotas() of the rows of each group, for any number of groups, in whole numbers."""
    counts, total = df.groupBy(by).agg(F.count("*").alias("n")), sum(weights)
    parts = counts.select(by, "n", F.posexplode(F.array(*map(F.lit, weights))).alias("part", "weight"))
    parts = parts.withColumns({"whole": F.floor(F.col("n") * F.col("weight") / total).cast("long"), "rest": F.col("n") * F.col("weight") % total})
    group = W.partitionBy(by)
    place = F.row_number().over(group.orderBy(F.desc("rest"), F.desc("weight"), "part"))
    more = F.when(place <= F.col("n") - F.sum("whole").over(group), 1).otherwise(0)
    dealt = parts.withColumn("quota", F.col("whole") + more)
    return dealt.groupBy(by, "n").agg(*[F.max(F.when(F.col("part") == k, F.col("quota"))).alias(name) for k, name in enumerate(names)])


def ranked(df: DataFrame, order: list[Column], name: str = "rank", within: str | None = None) -> DataFrame:
    """df with each row's place, from 1, in a total order whose first column is a digest; with within, among the rows that agree in it.

    Rows are ranged by the digest, and ranked in each range from its base, so that no label is one task. Only the ranges' sizes are gathered.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Digests are even over their first digits, so ranges need no sample.
    keyed = df.withColumn("__first", order[0]).withColumn("__label", F.col(within) if within else F.lit(0))
    keyed = keyed.withColumn("__part", F.floor(F.conv(F.substring("__first", 1, 8), 16, 10).cast("long") * parts / 4294967296).cast("int"))
    sizes = keyed.groupBy("__label", "__part").count()  # a row for each label and range
    before = F.sum("count").over(W.partitionBy("__label").orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    base = sizes.select(F.col("__label").alias("__l"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__label", "__part").orderBy("__first", *order[1:]))
    rows = keyed.join(F.broadcast(base), F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__part") == F.col("__p")))
    return rows.withColumn(name, own + F.col("__base")).drop("__part", "__first", "__base", "__label", "__l", "__p")


def split(df: DataFrame, group: str, seed: int = 42, weights: tuple[float, ...] = (8, 1, 1), names: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """df with a column split that keeps groups together: groups in the order of sha1(seed:group), cut at the quotas."""
    groups = ranked(df.select(F.col(group).alias("__group")).distinct(), [rng.digest(seed, F.col("__group")), F.col("__group")], "__rank")
    limits = quotas(df.select(group).distinct().count(), weights)
    name, upto = F.lit(names[-1]), sum(limits)
    for k in reversed(range(len(limits) - 1)):
        upto -= limits[k + 1]
        name = F.when(F.col("__rank") <= upto, names[k]).otherwise(name)
    return df.join(groups.select("__group", name.alias("split")), df[group] == F.col("__group")).drop("__group")


def stratified(df: DataFrame, key: str, label: str, share: float, seed: int = rng.SEED) -> DataFrame:
    """df with split: of each label, the first round(share * n) rows in hashed order are train, the others val."""
    sizes = df.groupBy(F.col(label).alias("__label")).agg(F.bround(F.count("*") * share).cast("long").alias("__quota"))
    ranks = ranked(df, _order(F.col(key), seed), "__rank", label)
    rows = ranks.join(F.broadcast(sizes), F.col(label).eqNullSafe(sizes["__label"]))
    return rows.withColumn("split", F.when(F.col("__rank") <= F.col("__quota"), "train").otherwise("val")).drop("__rank", "__quota", "__label")


def stratified_exact(df: DataFrame, key: str, label: str, train: int, val: int, seed: int = rng.SEED) -> DataFrame:
    """train and val rows exactly, each dealt to the labels by largest remainder of their shares; other rows, and those without a label, are left out."""
    df = df.where(F.col(label).isNotNull())
    n = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}  # a row per label
    labels = sorted(n)
    first = dict(zip(labels, quotas(min(train, sum(n.values())), tuple(n[x] for x in labels)), strict=True))
    second = dict(zip(labels, quotas(min(val, sum(n.values()) - sum(first.values())), tuple(n[x] for x in labels)), strict=True))
    take = F.lit(None).cast("string")
    for x in labels:
        take = F.when((F.col(label) == x) & (F.col("__rank") <= first[x]), "train").when((F.col(label) == x) & (F.col("__rank") <= first[x] + second[x]), "val").otherwise(take)
    return ranked(df, _order(F.col(key), seed), "__rank", label).withColumn("split", take).where("split IS NOT NULL").drop("__rank")


def first_of(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each key, by the order column: one aggregation, no window."""
    rest = [c for c in df.columns if c not in by]
    got = df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("__row"))
    return got.select(*by, "__row.*").select(*df.columns)


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key is not in b."""
    return a.join(b.select(key).distinct(), key, "left_anti")
