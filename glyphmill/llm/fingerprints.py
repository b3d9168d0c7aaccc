"""Operator 1: document fingerprints (canonical exact digest), in DataFrame functions only.

A text is brought to its canonical form (Unicode NFKC, full case folding, runs of white space to one
space, trimmed) and hashed with two independently seeded 64-bit xxhashes: a bucket of 128 bits. Buckets
that hold more than one row are compared byte by byte: if a bucket holds several canonical texts, the
second, third ... in byte order get a suffix. So equal canonical texts have equal fingerprints and
different ones never share one.

Defined results: a null text counts as the empty text, which has a fingerprint as well; repeated rows
and ids keep one result row each (rows of one id are neighbours in the order of their texts); rows without an id come
last; ids are read as whole numbers (long); an empty table gives an empty result; further columns are kept by
fingerprint(), whatever their names, and not read by the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Blocks of neighbouring ids: so many a shuffle partition, or of so many characters if that makes more. Their heads, MOST_BLOCKS at most, are broadcast.
BLOCKS_PER_PARTITION, BLOCK_CHARS, MOST_BLOCKS = 4, 64_000_000, 1 << 17


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, white space folded and trimmed; ASCII takes the short way to the same."""
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = nfkc(F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(F.lower(text)), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: xxhash64 under two seeds."""
    half = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(half(canon), half(F.lit("second half"), canon))


def numbered(texts: DataFrame) -> DataFrame:
    """(bucket, canon, variant) of texts (bucket, canon): the place of each text among those of its bucket, in byte order."""
    distinct = texts.groupBy("bucket", "canon").agg(F.count("*").alias("rows"))
    return distinct.withColumn("variant", F.row_number().over(W.partitionBy("bucket").orderBy("canon")) - 1)


def fingerprint(docs: DataFrame, text: str = "text", hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """docs with a column fingerprint, in place of one that it may have.

    The buckets with several rows are found from the hashes alone; only their texts are then shuffled,
    collapsed per partition, and compared. Other columns of docs, whatever their names, are kept.
    """
    canon, bucket, b, c, v = common.unused(docs, "__canon", "__bucket", "__b", "__c", "__v")
    mark = docs.drop("fingerprint").select("*", canonical(common.text_or_empty(text)).alias(canon)).withColumn(bucket, hash_of(F.col(canon)))
    shared = mark.groupBy(F.col(bucket).alias(b)).agg(F.count("*").alias(v)).where(F.col(v) > 1).select(b)
    texts = mark.join(shared, mark[bucket] == shared[b], "left_semi").select(F.col(bucket).alias("bucket"), F.col(canon).alias("canon"))
    extra = common.durable(numbered(texts).where("variant > 0").select(F.col("bucket").alias(b), F.col("canon").alias(c), F.col("variant").alias(v)), "variants")
    kept = [x for x in docs.columns if x.lower() != "fingerprint"]
    if extra.isEmpty():
        common.remove(extra)
        return mark.select(*[F.col(f"`{x}`") for x in kept], F.col(bucket).alias("fingerprint"))
    found = mark.join(extra, (mark[bucket] == extra[b]) & (mark[canon] == extra[c]), "left")
    name = F.concat(bucket, F.when(F.col(v) > 0, F.concat(F.lit("-"), F.col(v))).otherwise(""))
    return found.select(*[F.col(f"`{x}`") for x in kept], name.alias("fingerprint"))


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, a long; text, bucket, ...) with next_id, next_text, next_bucket: the next row in descending doc_id, after the last the first.

    Ids are cut at quantiles into blocks, whose number grows with the text; one exchange brings each block together with a copy of the
    first row of the block below it. Ties of doc_id go by text.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = min(MOST_BLOCKS, max(BLOCKS_PER_PARTITION * common.shuffle_parts(spark), chars // BLOCK_CHARS))
    cuts = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    each = max(16, math.isqrt(len(cuts)))
    runs = [cuts[k : k + each] for k in range(0, len(cuts), each)]
    below = lambda ids: F.size(F.filter(ids, lambda b: b < F.col("doc_id")))
    if cuts:
        array = lambda ids: F.array(*[F.lit(x).cast("long") for x in ids])
        high = below(array([r[-1] for r in runs]))
        block = high * each + F.when(high < len(runs), below(F.element_at(F.array(*map(array, runs)), F.least(high + 1, F.lit(len(runs)))))).otherwise(0)
    else:
        block = F.lit(0)
    dealt = docs.withColumn("block", block.cast("int"))
    heads = sorted(dealt.groupBy("block").agg(F.max("doc_id").alias("top")).collect(), reverse=True)
    follows = spark.createDataFrame([(heads[(k + 1) % len(heads)].top, h.block) for k, h in enumerate(heads)], "head long, target int")
    guests = docs.join(F.broadcast(follows), docs["doc_id"].eqNullSafe(follows["head"])).withColumnRenamed("target", "block").drop("head").withColumn("guest", F.lit(True))
    rows = dealt.withColumn("guest", F.lit(False)).unionByName(guests)
    order = W.partitionBy("block").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    for c, to in (("doc_id", "next_id"), ("text", "next_text"), ("bucket", "next_bucket")):
        rows = rows.withColumn(to, F.lead(c).over(order))
    return rows.where("not guest").drop("guest", "block")


def edited(text: Column, n: Column, following: Column) -> Column:
    """text, whose last floor(n / 2) code points give way to as many (or all) of the following text's first."""
    half = F.floor(n / 2).cast("int")
    return F.concat(F.left(text, n - half), F.left(following, half))


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", common.text_or_empty("text").alias("text"))
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    rows = neighbours(docs.withColumn("bucket", wide_hash(canonical(F.col("text")))))
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.col("next_text")))
    first = common.durable(rows.select("doc_id", "next_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "bucket", "next_bucket", wide_hash(canonical(F.col("edited"))).alias("edited_bucket")), "hashes")
    both = first.select("bucket").unionByName(first.select(F.col("edited_bucket").alias("bucket")))
    shared = both.groupBy("bucket").count().where("count > 1").select("bucket")
    own = first.join(shared, "bucket", "left_semi").select("doc_id")
    pairs = first.join(shared.withColumnRenamed("bucket", "edited_bucket"), "edited_bucket", "left_semi").select("doc_id", "next_id", "n_chars")
    own, pairs = common.durable(own.distinct(), "own"), common.durable(pairs.distinct(), "edited")
    texts = docs.join(common.sized(own), "doc_id", "left_semi").select(canonical(F.col("text")).alias("canon"))
    n_pairs = pairs.count()
    need = pairs.select("doc_id").union(pairs.select("next_id")).distinct()
    some = docs.join(common.sized(need), "doc_id", "left_semi").select("doc_id", "text")
    after = some.select(F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    told = some.join(common.sized(pairs, n_pairs), "doc_id").where(F.char_length("text") == F.col("n_chars")).join(after, "next_id")
    texts = texts.unionByName(told.select(canonical(edited(F.col("text"), F.col("n_chars"), F.col("next_text"))).alias("canon")))
    collided = numbered(texts.select(wide_hash(F.col("canon")).alias("bucket"), "canon")).where("variant > 0")
    extra = common.durable(collided.select("bucket", "canon", "variant"), "variants")
    if extra.isEmpty():
        same = lambda c: (F.col("fingerprint") == F.col(c)).cast("double")
        out = first.withColumnsRenamed({"bucket": "fingerprint", "edited_bucket": "edited_fingerprint"})
        return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", same("edited_fingerprint").alias("near_edited"), same("next_bucket").alias("near_next"))
    out = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *[canonical(F.col(c)).alias(to) for c, to in (("text", "c1"), ("edited", "c2"), ("next_text", "c3"))])
    for c in ("c1", "c2", "c3"):
        variant = extra.select(F.col("canon").alias(c), F.col("variant").alias(f"{c}_v"))
        out = out.join(variant, c, "left").withColumn(f"{c}_f", F.concat(wide_hash(F.col(c)), F.when(F.col(f"{c}_v") > 0, F.concat(F.lit("-"), F.col(f"{c}_v"))).otherwise("")))
    near = lambda c: (F.col("c1_f") == F.col(c)).cast("double")
    return out.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", F.col("c1_f").alias("fingerprint"), F.col("c2_f").alias("edited_fingerprint"), near("c2_f").alias("near_edited"), near("c3_f").alias("near_next"))
