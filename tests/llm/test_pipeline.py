"""The pipeline's stages one by one, each on what the one before has kept."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from glyphmill.llm import common, decontamination, line_templates, toxicity

from ..helpers import DATA
from .test_operators import brute_components, gapless


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "packing"]

    labels = common.table(spark, DATA, "labels")
    scored = toxicity.scored(docs, toxicity.train(docs, labels))
    clean = common.durable(stages["toxicity"](spark, docs, DATA), "a")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert clean.columns == columns and ids(clean) == ids(scored.where("__p_toxic < 0.5"))

    lines = common.durable(stages["line_dedup"](spark, clean, DATA), "b")
    assert lines.columns == columns
    assert lines.where(F.col("n_chars") != F.char_length("text")).isEmpty()
    again = line_templates.deduplicated(clean).select("doc_id", F.col("text").alias("t"))
    assert lines.join(again, "doc_id").where("text <> t AND trim(t) <> ''").isEmpty()
    cut = again.join(clean.where("trim(text) <> ''").select("doc_id"), "doc_id")
    assert set(ids(cut.where("t RLIKE '[^ \\n]'"))) <= set(ids(lines))

    near = common.durable(stages["jaccard_join"](spark, lines, DATA), "c")
    groups = brute_components({r.doc_id: r.text for r in lines.collect()}, 5, 80, 100)
    assert near.columns == columns and ids(near) == sorted(k for k, (_, c) in groups.items() if c == k)

    held = common.durable(stages["decontamination"](spark, near, DATA), "d")
    found = decontamination.matched(near, common.table(spark, DATA, "benchmark"), locate=False)
    assert held.columns == columns and ids(held) == ids(found.where(~decontamination.contaminated()))

    pieces = stages["packing"](spark, held, DATA).collect()
    assert {r.doc_id for r in pieces} == set(ids(held))
    gapless(pieces)


def test_odd_and_empty_tables(spark, edge_dir, empty_dir):
    assert {r.doc_id for r in pipeline.run(spark, edge_dir).collect()}
    assert pipeline.run(spark, empty_dir).count() == 0


def test_two_runs_in_one_session(spark):
    a, b = pipeline.run(spark, DATA), pipeline.run(spark, DATA)
    assert a.count() == b.count() > 0


def test_tables_of_stages_are_removed(spark):
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.iterdir())
    assert pipeline.run(spark, DATA).count()
    assert [p.name.split("-")[0] for p in set(shared.iterdir()) - before] == ["pieces"]
