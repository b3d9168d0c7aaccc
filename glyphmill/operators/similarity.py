"""Likeness of a text and another made from it, by the tokens they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def shared_tokens(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, precision, recall, f1, cosine) of two columns of texts over their bags of lower-case tokens.

    Precision is the share of b's tokens that a has, recall the reverse. A key without a token on either side is left out; one with tokens on
    one side only has zeros.
    """
    bag = lambda c, x, y: F.transform(text.split_words(F.lower(F.coalesce(c, F.lit("")))), lambda t: F.struct(t.alias("t"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    rows = pairs.select(key, F.inline(F.concat(bag(F.col(a), 1, 0), bag(F.col(b), 0, 1)))).groupBy(key, "t").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    share = lambda top, under: F.round(F.when(under > 0, top / under).otherwise(0.0), 6)
    x, y, both = F.sum("x"), F.sum("y"), F.sum(F.least("x", "y"))
    lengths: Column = F.sqrt(F.sum(F.col("x") * F.col("x")).cast("double") * F.sum(F.col("y") * F.col("y")))
    return rows.groupBy(key).agg(share(both, y).alias("precision"), share(both, x).alias("recall"), share(2 * both, x + y).alias("f1"), share(F.sum(F.col("x") * F.col("y")), lengths).alias("cosine"))
