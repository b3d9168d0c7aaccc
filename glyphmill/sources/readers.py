"""Readers of example files: JSON lines, JSON containers, CSV, paired records, question-answer records.

Records are read as VARIANT, so that rows of any shape are scanned once; the priority lists of keys are
coalesced into fixed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as norm
from ..functions import rng

#: Keys of input files, the first that is there counts.
CONTAINERS = ("data", "examples", "items", "records")
CSV_TEXT = ("text", "answer", "generation", "content", "article", "body")
CSV_LABEL = ("label", "labels", "target", "class", "y")
CSV_SOURCE = ("source", "src", "domain")


def field(record: Column, *paths: str) -> Column:
    """The first of the paths that holds a string or number, as a string."""
    return F.coalesce(*[F.try_variant_get(record, f"$.{p}", "string") for p in paths])


def scan_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(record, file) of each line that is not blank; a line that is not JSON fails the query."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.json*").where(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("record"), F.col("_metadata.file_name").alias("file"))


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """(record, position) of whole JSON files: a list, the first list among CONTAINERS, or one record."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = [F.try_variant_get("v", f"$.{k}", "array<variant>") for k in CONTAINERS]
    items = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), *lists, F.array("v"))
    return whole.select(F.posexplode(items).alias("position", "record"))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, label, source) of CSV files with a header, whose column names match in any case; rows without text or label go."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    by_name = {c.strip().lower(): c for c in raw.columns}
    pick = lambda names: [F.col(f"`{by_name[n]}`") for n in names if n in by_name] or [F.lit(None).cast("string")]
    text = norm.text_of(*pick(CSV_TEXT))
    out = raw.select(F.coalesce(*pick(norm.ID_KEYS)).alias("id"), text.alias("text"), norm.label(F.coalesce(*pick(CSV_LABEL))).alias("label"), F.coalesce(*pick(CSV_SOURCE)).alias("source"))
    return out.where("text IS NOT NULL AND label IS NOT NULL")


def examples(records: DataFrame, record: str = "record") -> DataFrame:
    """(id, text, label, lang, source, model) of flat records; those without text or a label go."""
    v = F.col(record)
    text = norm.text_of(*[F.try_variant_get(v, f"$.{k}", "string") for k in norm.TEXT_KEYS])
    key = F.coalesce(norm.key(field(v, *norm.ID_KEYS)), F.substring(F.sha1(text.cast("binary")), 1, 16))
    out = records.select(key.alias("id"), text.alias("text"), norm.label(field(v, "label")).alias("label"), *[field(v, k).alias(k) for k in ("lang", "source", "model")])
    return out.where("text IS NOT NULL AND label IS NOT NULL")


def union(*parts: DataFrame) -> DataFrame:
    """All rows of parts that may lack each other's columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flatten_answers(df: DataFrame, question: str, human: str, machine: str, *keep: str) -> DataFrame:
    """(question, ..., text, label, place) of records with arrays of human and machine answers; blank answers go."""
    tagged = lambda c, y: F.transform(F.col(c), lambda t, k: F.struct(norm.text_of(t).alias("text"), F.lit(y).alias("label"), k.alias("place")))
    both = F.concat(F.coalesce(tagged(human, 0), F.array()), F.coalesce(tagged(machine, 1), F.array()))
    return df.select(question, *keep, F.explode(both).alias("a")).select(question, *keep, "a.text", "a.label", "a.place").where("text IS NOT NULL")


def balanced_answers(answers: DataFrame, question: str, one_each: bool = False, seed: int = rng.SEED) -> DataFrame:
    """As many human as machine answers of each question, in hashed order: the smaller number, or one."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy(question, "label").orderBy(rng.digest(seed, F.col(question), F.col("label"), F.col("place"))))
    sizes = answers.groupBy(question).agg(F.least(F.sum(1 - F.col("label")), F.sum("label")).alias("__size"))
    limit = F.least(F.lit(1), F.col("__size")) if one_each else F.col("__size")
    return answers.withColumn("__n", n).join(sizes, question).where(F.col("__n") <= limit).drop("__n", "__size")


LISTS = (("original", 0), ("sample", 1), ("sampled", 1), ("rewritten", 1))


def flatten_lists(df: DataFrame, lists: tuple[tuple[str, int], ...] = LISTS) -> DataFrame:
    """(id, text, label, split) of records with lists of texts; the list's name is the split."""
    own = [c for c in lists if c[0] in df.columns]

    def tagged(c: str, y: int) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.struct(norm.text_of(t).alias("text"), F.lit(y).alias("label"), F.lit(c).alias("split")))

    parts = [tagged(c, y) for c, y in own]
    return df.select("id", F.explode(F.concat(*parts)).alias("a")).select("id", "a.*").where("text IS NOT NULL")


def attack_samples(df: DataFrame) -> DataFrame:
    """Attacked texts of paired records (id, lang, sample array of (attack, text)): samples of the base are left out unless nothing else is there."""
    other = F.filter("sample", lambda x: ~F.lower(x["attack"]).isin(*norm.BASE_SUFFIXES))
    used = F.when(F.size(other) > 0, other).otherwise(F.col("sample"))
    return df.select("id", "lang", F.explode(used).alias("s")).select("id", "lang", F.col("s.attack").alias("attack"), norm.attack_abbreviation(F.col("s.attack")).alias("attack_short"), F.col("s.text").alias("text"))


def builder_view(df: DataFrame, post: bool) -> DataFrame:
    """The first sample of each paired record, or (post) the last of those with two at least."""
    rows = df.where(F.size("sample") >= (2 if post else 1))
    return rows.select("id", F.element_at("sample", -1 if post else 1).alias("s")).select("id", F.col("s.attack").alias("attack"), F.col("s.text").alias("text"))


def unpivot_attacks(df: DataFrame, key: str, prefix: str = "text_") -> DataFrame:
    """(key, attack, text) of a column for each attack; those of the base are left out."""
    columns = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].lower() not in norm.BASE_SUFFIXES]
    return df.unpivot([key], columns, "attack", "text").where(norm.text_of(F.col("text")).isNotNull())


def official_keys(records: DataFrame, record: str = "record") -> DataFrame:
    """(text, generator, label) of records in which the generator decides the label: without one, 1 means human."""
    v = F.col(record)
    generator = norm.key(field(v, "src"))
    return records.select(field(v, "text").alias("text"), F.coalesce(generator, F.lit("human")).alias("generator"), F.when(generator.isNotNull() & (F.lower(generator) != "human"), 1).when(generator.isNotNull(), 0).otherwise(1 - field(v, "label").cast("int")).alias("label"))


def group_columns(df: DataFrame, candidates: tuple[str, ...]) -> list[str]:
    """Those candidates that hold anything in the first 512 rows: one bounded job for all."""
    own = [c for c in candidates if c in df.columns]
    seen = df.limit(512).agg(*[F.max((F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").cast("int")).alias(c) for c in own]).first() if own else {}
    return [c for c in own if seen[c]]
