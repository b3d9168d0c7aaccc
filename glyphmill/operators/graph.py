"""Coherence graph of entities: edges between neighbours in a sentence, and between equal entities of different sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text


def entities(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, sentence, place, entity): words that begin with a capital, in order."""
    rows = docs.select(key, F.posexplode(text.sentences(F.col(column))).alias("sentence", "s"))
    found = F.filter(F.regexp_extract_all("s", F.lit(r"\p{L}+"), F.lit(0)), lambda w: w.rlike("^[A-Z][a-z]+$"))
    return rows.select(key, "sentence", F.posexplode(found).alias("place", "entity"))


def inner_edges(nodes: DataFrame, key: str) -> DataFrame:
    after = W.partitionBy(key, "sentence").orderBy("place")
    return nodes.withColumn("next", F.lead("entity").over(after)).where("next IS NOT NULL").select(key, "sentence", "place", "entity", "next")


def inter_edges(nodes: DataFrame, key: str) -> DataFrame:
    """Pairs of different sentences of a document that share an entity. The result is a list of pairs by definition; it stays inside documents."""
    rows = nodes.select(key, "sentence", "entity").distinct()
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.sentence") < F.col("b.sentence"))
    return a.join(b, on).select(F.col(f"a.{key}").alias(key), F.col("a.entity").alias("entity"), F.col("a.sentence").alias("first"), F.col("b.sentence").alias("second"))
