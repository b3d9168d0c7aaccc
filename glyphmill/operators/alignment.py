"""Alignment of base examples with attacked variants, and attack success rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rng
from . import ranges, sampling
from .sampling import first_of


def pairs_by_id(base: DataFrame, attack: DataFrame, key: str = "k", order: str = "seq") -> DataFrame:
    """Base rows joined with the first attack row of their key."""
    return base.where(f"{key} IS NOT NULL").join(first_of(attack.where(f"{key} IS NOT NULL"), [key], order), key)


def pairs_by_order(base: DataFrame, attack: DataFrame, order: str = "seq") -> DataFrame:
    """The n-th base row joined with the n-th attack row, by an id that orders each side densely within blocks."""
    return numbered(base, order, "n").join(numbered(attack, order, "n"), "n")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with the place of each row (from 1) by a numeric column: ranges of it are ranked apart and shifted by the sizes of those below."""
    rows = ranges.ranged(df, order, ranges.cuts(df, order), "__part")
    sizes = rows.groupBy("__part").count()
    base = sizes.select("__part", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))  # a row for each range
    return rows.join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.row_number().over(W.partitionBy("__part").orderBy(order))).drop("__part", "__base", order)


def one_to_many(base: DataFrame, variants: DataFrame, key: str = "k") -> DataFrame:
    """One row: bases, bases without variants, keys with variants, and variants per base that has some."""
    per = variants.groupBy(key).agg(F.count("*").alias("v"))
    rows = base.select(key).distinct().join(per, key, "left")
    return rows.agg(F.count("*").alias("bases"), F.sum(F.col("v").isNull().cast("long")).alias("missing"), F.count("v").alias("keys"), F.coalesce(F.sum("v"), F.lit(0)).alias("variants"), F.round(F.avg("v"), 6).alias("per_base"))


def base_correct(base: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(k, ok) of base examples (k, y, prob)."""
    return base.groupBy("k").agg(F.max(((F.col("prob") >= threshold).cast("int") == F.col("y"))).alias("ok"))


def variants_of_correct(base: DataFrame, variants: DataFrame, threshold: float = 0.5) -> DataFrame:
    return variants.join(base_correct(base, threshold).where("ok"), "k", "left_semi")


def attack_success(base: DataFrame, variants: DataFrame, threshold: float = 0.5, by_method: bool = True) -> DataFrame:
    """Attack success on variants (k, method, y, prob) of correctly classified bases: a base falls if any of its variants fails.

    Two aggregations, the first by method and base; a method's bases without variants count in base_correct_n alone.
    """
    correct = base_correct(base, threshold).where("ok")
    bases = correct.agg(F.count("*").alias("base_correct_n"))
    used = variants.join(correct, "k", "left_semi").withColumn("right", ((F.col("prob") >= threshold).cast("int") == F.col("y")).cast("int"))
    keys = ["method", "k"] if by_method else ["k"]
    per = used.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("right").alias("right"), F.max(1 - F.col("right")).alias("fell"))
    out = (per.groupBy("method") if by_method else per.groupBy()).agg(F.count("*").alias("attack_eval_n"), F.sum("n").alias("attack_variant_n"), F.round(F.sum("right") / F.sum("n"), 6).alias("variant_acc"), F.round(1 - F.avg("fell"), 6).alias("attack_acc"), F.round(F.avg("fell"), 6).alias("asr"))
    return out.crossJoin(F.broadcast(bases))  # one row


def pairwise_success(base: DataFrame, attack: DataFrame, threshold: float = 0.5, order: str = "seq") -> DataFrame:
    """The same for one variant a base, the first of its key."""
    rows = pairs_by_id(base.where((F.col("prob") >= threshold).cast("int") == F.col("y")).select("k"), attack, "k", order)
    right = ((F.col("prob") >= threshold).cast("int") == F.col("y")).cast("int")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("attack_acc"), F.round(1 - F.avg(right), 6).alias("asr"))


def success_summary(by_method: DataFrame) -> DataFrame:
    """Mean success over methods, and the mean weighted by evaluated bases (by all correct ones where none were)."""
    w = F.coalesce(F.nullif(F.col("attack_eval_n"), F.lit(0)), F.col("base_correct_n"))
    return by_method.agg(F.count("*").alias("methods"), F.round(F.avg("asr"), 6).alias("asr_mean"), F.round(F.sum(F.col("asr") * w) / F.sum(w), 6).alias("asr_weighted"))


def paired_classes(df: DataFrame, bucket: str, label: str, key: str, seed: int = rng.SEED) -> DataFrame:
    """(bucket, n, human, machine): the n-th human and the n-th machine row of each bucket, in hashed order."""
    n = F.row_number().over(W.partitionBy(bucket, label).orderBy(rng.digest(seed, F.col(key)), key))
    rows = df.select(bucket, label, key, n.alias("n"))
    human, machine = (rows.where(F.col(label) == y).select(bucket, "n", F.col(key).alias(c)) for y, c in ((0, "human"), (1, "machine")))
    return human.join(machine, [bucket, "n"])


#: Columns that tell what a text answers or where it is from, the closest first.
PAIR_KEYS = ("id", "qid", "question_id", "question", "source", "lang")
#: Rows of one bucket and class beyond which their places are counted in ranges.
LARGE = 100_000


def bucket_of(df: DataFrame, keys: tuple[str, ...] = PAIR_KEYS) -> Column:
    """The first of the columns that df has and that is not blank in a row, with its name; null without any."""
    there = [k for k in keys if k in df.columns]
    return F.coalesce(*[F.when(F.trim(F.col(f"`{k}`").cast("string")) != "", F.concat(F.lit(f"{k}:"), F.col(f"`{k}`").cast("string"))) for k in there], F.lit(None).cast("string"))


def _placed(rows: DataFrame, seed: int) -> DataFrame:
    """rows (bucket, y, key) with n, each row's place in its bucket and class, in hashed order."""
    sizes = rows.groupBy("bucket", "y").count().where(F.col("count") > LARGE)
    large = F.broadcast(sizes.select(F.col("bucket").alias("of"), F.col("y").alias("class")))  # few, by their size
    same = F.col("bucket").eqNullSafe(F.col("of")) & (F.col("y") == F.col("class"))
    order = [rng.digest(seed, F.col("key")), F.col("key")]
    n = F.row_number().over(W.partitionBy("bucket", "y").orderBy(*order))
    few = rows.join(large, same, "left_anti").withColumn("n", n)
    many = rows.join(large, same, "left_semi").withColumn("within", F.to_json(F.struct("bucket", "y")))
    return few.unionByName(sampling.ranked(many, order, "n", "within").select(*few.columns))


def paired_by_keys(df: DataFrame, label: str, key: str, keys: tuple[str, ...] = PAIR_KEYS, pair_by: str | None = None, seed: int = rng.SEED) -> DataFrame:
    """(bucket, n, human, machine): pairs of keys of the two classes, from each bucket as many as the smaller class has.

    A row's bucket is its first key that is not blank (pair_by before all others); rows without any share one. If no bucket has both classes,
    the pairs are made of all rows, in the bucket null. Rows of other classes, or of none, have no part.
    """
    keys = (pair_by, *[k for k in keys if k != pair_by]) if pair_by else keys
    rows = df.where(F.col(label).isin(0, 1)).select(bucket_of(df, keys).alias("bucket"), F.col(label).cast("int").alias("y"), F.col(key).alias("key"))
    both = rows.groupBy("bucket").agg(F.countDistinct("y").alias("classes")).where("classes = 2")
    if both.isEmpty():
        rows = rows.withColumn("bucket", F.lit(None).cast("string"))
    placed = _placed(rows, seed)
    human, machine = (placed.where(F.col("y") == y).select(F.col("bucket").alias(f"b{y}"), F.col("n").alias(f"n{y}"), F.col("key").alias(c)) for y, c in ((0, "human"), (1, "machine")))
    joined = human.join(machine, F.col("b0").eqNullSafe(F.col("b1")) & (F.col("n0") == F.col("n1")))
    return joined.select(F.col("b0").alias("bucket"), F.col("n0").cast("int").alias("n"), "human", "machine")


def quality_means(df: DataFrame, before: str, after: list[str]) -> DataFrame:
    """Mean change of each measure from a record to its samples, without nulls and NaN: (measure, n, mean)."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), (F.col(c) - F.col(f"{before}_{c}")).alias("d")) for c in after]))
    rows = df.select(parts.alias("m")).select("m.measure", "m.d").where("d IS NOT NULL AND NOT isnan(d)")
    return rows.groupBy("measure").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"))
