"""Operator 11 against brute force: the code, short fingerprints, passes, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import common, exact_dedup


@pytest.mark.parametrize(("span", "n"), [(1, 1), (5, 5), (1000, 17), (1 << 20, 1), (1 << 40, 3000), (1 << 62, 100)])
def test_code_round_trip(span, n):
    rnd = random.Random(n)
    numbers = np.array(sorted(rnd.sample(range(min(span, 1 << 40)), n)), np.uint64)
    code = exact_dedup.encoded(numbers, span)
    assert (exact_dedup.decoded(code, n) == numbers).all()


def test_code_is_short():
    numbers = np.unique(np.random.default_rng(1).integers(0, 1 << 30, 1 << 16, np.uint64))
    # The bound of such sets is log2(e * span / n) bits a number.
    assert len(exact_dedup.encoded(numbers, 1 << 30)) * 8 < 16.2 * len(numbers)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def brute(rows):
    by = defaultdict(list)
    for key, text in rows:
        by[lowered(text)].append(key)
    out = []
    for text, keys in by.items():
        ids = [k for k in keys if k is not None]
        keep = max(ids, default=None)
        order = sorted(keys, key=lambda k: (k is None, -(k or 0)))
        out += [(k, keep if len(keys) > 1 else k, len(keys), at == 0, hashlib.sha256(text.encode()).hexdigest()) for at, k in enumerate(order)]
    return sorted(map(str, out))


def texts(n=400, seed=3):
    rnd = random.Random(seed)
    pool = ["", None, "A b C", "a B c", "Ä b", "ä b", "x" * 50_000, *[f"Text {k}" for k in range(60)]]
    rows = [(k, rnd.choice(pool) if rnd.random() < 0.7 else f"own {k}") for k in range(n)]
    return [*rows, rows[0], rows[0], (None, "text 1"), (None, "only without ids"), (None, "Only without ids"), *[(n + k, "HOT copy" if k % 2 else "hot copy") for k in range(n // 2)]]


@pytest.mark.parametrize("spare", [12, -4])
@pytest.mark.parametrize("few", [1_000_000, 5])
def test_against_brute_force(spark, monkeypatch, folder, spare, few):
    """Also with fingerprints so short that most suspects are none, and with marks in many passes over the files."""
    monkeypatch.setattr(exact_dedup, "SPARE_BITS", spare)
    monkeypatch.setattr(common, "BROADCAST_ROWS", few)
    rows = texts()
    path = folder("dedup", documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    got = exact_dedup.op11_exact_dedup(spark, path).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_small_blocks(spark, monkeypatch, folder):
    monkeypatch.setattr(exact_dedup, "BLOCK", 16)
    rows = texts(150)
    path = folder("blocks", documents=spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(str(tuple(r)) for r in exact_dedup.op11_exact_dedup(spark, path).collect()) == brute(rows)


def test_columns_of_documents(spark, edge):
    """A table that is not a scan; columns named as the operator's own, the hidden file column among them."""
    docs = edge.withColumn("kept", F.lit("mine")).withColumn("_metadata", F.lit(1)).withColumn("own", F.lit(2)).withColumn("digest", F.lit(3)).withColumn("hot", F.lit(4))
    told = exact_dedup.decisions(docs)
    assert sorted(told.columns) == sorted([*docs.columns, "keep_id", "group_size", "text_sha256"])
    stay = exact_dedup.deduplicated(docs)
    assert stay.columns == docs.columns
    left = stay.collect()
    assert {r.kept for r in left} == {"mine"}
    assert len(left) == len({lowered(r.text) for r in docs.collect()})


def test_suspects_only_are_shuffled(spark, folder):
    """Of texts without copies hardly one is a suspect."""
    path = folder("alone", documents=spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    rows = exact_dedup.addressed(common.table(spark, path, "documents"), "doc_id", "text")
    words = exact_dedup.suspects(rows.select("file", "row", F.xxhash64("norm").alias("hash")), 20_000)
    assert (words.agg(F.sum(F.bit_count("bits"))).first()[0] or 0) < 40
