"""The four verbs end to end, with plug-ins."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphmill.plans import api


class Echo:
    def generate(self, prompts):
        return [p + " again" for p in prompts]


class Failing:
    def generate(self, prompts):
        raise RuntimeError("no model")


class Length:
    def score(self, texts):
        return [len(t) for t in texts]


def test_verbs(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), "text").limit(40)
    built = api.build(docs, Echo, prefix_words=5).persist()
    assert built.count() == 80
    assert built.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    attacked = api.attack(built, [{"type": "typo", "mode": "delete"}, {"type": "homo"}], path=f"file://{tmp_path}/attacks")
    assert attacked.where("label = 0").isEmpty() and spark.read.json(f"file://{tmp_path}/attacks").count() == attacked.count()
    scored = api.scored_by(built.select("id", "text", F.col("label"), F.lit("en").alias("lang")), Length)
    model = api.calibrate(scored)
    variants = scored.where("label = 1").select(F.col("id").alias("k"), F.lit("m").alias("method"), F.col("label").alias("y"), "score")
    out = api.detect(scored, model, variants=variants)
    summary = out.relations["summary"].first()
    assert summary.n == 80 and 0.5 <= summary.auroc <= 1
    assert out.relations["asr_by_method"].first().asr == 0.0
    out.write(f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/summary").count() == 1


class Picky:
    """Fails on a batch that has a bad prompt."""

    def generate(self, prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no text")
        return [p + " again" for p in prompts]


def test_failing_generator_never_gives_a_prompt(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id int, prompt string").coalesce(1)
    with pytest.raises(Exception, match="GenerationError"):
        api.generated(df, Picky).collect()
    got = {r.id: (r.generated, r.why) for r in api.generated(df, Picky, errors="why").collect()}
    assert got == {1: ("good again", None), 2: (None, "RuntimeError: no text"), 3: ("fine again", None)}


def test_build_labels_no_prompt_as_machine(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad words here")], "id int, text string")
    with pytest.raises(Exception, match="GenerationError"):
        api.build(docs, Failing).collect()
    rows = {r.id: (r.text, r.label, r.why) for r in api.build(docs, Picky, errors="why").collect()}
    assert rows == {"1-human": ("good words here", 0, None), "2-human": ("bad words here", 0, None), "1-gen": ("good words here again", 1, None), "2-gen": (None, None, "RuntimeError: no text")}


def test_built_dataset_holds_every_document(spark):
    from glyphmill.plans.registry import QUERIES

    path = "/root/testdata/sf0.001"
    built = QUERIES["build_dataset"](spark, path).persist()
    texts = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    assert {r.id: (r.text, r.lang) for r in built.where("label = 0").collect()} == {f"{k}-human": v for k, v in texts.items()}
    assert {r.id for r in built.where("label = 1").collect()} == {f"{k}-gen" for k in texts}
    assert built.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    made = {r.group: r.text.split() for r in built.where("label = 1").collect()}
    assert all(made[str(k)][: len(t.split()[:64])] == t.split()[:64] for k, (t, _) in texts.items())


def test_small_tables_of_few_files_are_dealt_out(spark, tmp_path, monkeypatch):
    from glyphmill.plans import base

    cores = spark.sparkContext.defaultParallelism
    spark.range(100).coalesce(1).write.parquet(f"file://{tmp_path}/one")
    spark.range(100).repartition(2 * cores).write.parquet(f"file://{tmp_path}/many")
    one, many = (spark.read.parquet(f"file://{tmp_path}/{n}") for n in ("one", "many"))
    assert base.spread(one).rdd.getNumPartitions() == cores and base.spread(one).count() == 100
    assert base.spread(many) is many
    monkeypatch.setattr(base, "SMALL", 1)
    assert base.spread(one) is one
