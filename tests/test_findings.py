"""Queries on odd documents against their SQL, and steps that are to stay small."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.plans.registry import ORACLES, QUERIES

from .helpers import same


def tables(spark, tmp_path, **given):
    """A folder of tables (rows, schema) as Parquet files, and DuckDB with views of them."""
    c = duckdb.connect()
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), c


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["words", "syllables", "readability"])
def test_documents_without_latin_words(spark, tmp_path, name):
    texts = ["The end. It's late", "123 45.6 | 7!", "Съешь ещё булок. Да", "漢字", "eé 1"]
    path, c = tables(spark, tmp_path, documents=([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], DOCS))
    same(QUERIES[name](spark, path), c, ORACLES[name])


def test_shuffle_files_of_written_tables_go(spark, tmp_path):
    """What a durable table or a table of a model shuffled is gone when it is written, and the session's own setting is as before."""
    from glyphmill.llm import common
    from glyphmill.operators import language_model as lm

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = held()
    with common.scratch(spark, "tidy"):
        assert common.durable(counted, "counted").count() == 7
        assert len(counted.withColumn("n", F.col("count") + 1).collect()) == 7
    assert lm._kept(counted, f"file://{tmp_path}", "kept").agg(F.sum("count")).first()[0] == 1000
    assert held() <= before + 1  # the last sum's own
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) in (None, "false")


def test_ranks_and_moments_of_a_history_in_one_pass(spark):
    """The model's own pairs have their ranks and their history's moments without another shuffle, in batches that cut histories, as the general way gives them."""
    from glyphmill.operators import language_model as lm

    texts = [" ".join(f"w{(k * j * j + j) % (7 + k)}" for j in range(60)) for k in range(1, 9)] + ["a b a", "", None, "hub " + " hub ".join(f"x{j % 40}" for j in range(200))]
    tokens = lm.token_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        model = lm.fit(tokens, ranked=True)
        own = {(r.h, r.t): r for r in model.pairs.collect()}
        general = lm.scored_pairs(model, tokens.select("h", "t").distinct())
        ranks = {(r.h, r.t): r["rank"] for r in lm.ranks(general, model).collect()}
        assert {k: r["rank"] for k, r in own.items()} == ranks and len(set(ranks.values())) > 10
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    for h in {h for h, _ in own}:
        rows = [r for r in own.values() if r.h == h]
        assert {r.ch for r in rows} == {sum(r.c for r in rows)}
        assert len({(r.entropy, r.variance, r.cross, r.best) for r in rows}) == 1
    joins = lm.statistics(tokens, model, "id", fitted=True)._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins == 2  # tokens with pairs, and the counts with the unigrams where no folder holds the pairs


def test_dnagpt_of_fitted_texts_takes_their_own_pairs(spark, monkeypatch):
    from glyphmill.operators import detectors
    from glyphmill.operators import language_model as lm

    class Enough(Exception):
        pass

    def stop(*_):
        raise Enough

    docs = spark.createDataFrame([(1, "a b a c"), (2, None)], "id long, text string")
    model = lm.fit(lm.token_table(docs, "id"))
    asked, found = [], lm.scored_pairs
    monkeypatch.setattr(lm, "scored_pairs", lambda model, needed=None: asked.append(needed) or found(model, needed))
    monkeypatch.setattr(detectors.generation, "guide", stop)
    with pytest.raises(Enough):
        detectors.dnagpt(docs, model, "id", fitted=True)
    assert asked == [None]


def test_fills_draw_in_cells_without_rows_of_candidates(spark, monkeypatch):
    """Lists meet in the cells of a grid, of any size, and no table of candidates is made."""
    from glyphmill.operators import infilling
    from glyphmill.operators import language_model as lm

    def rows(*_):
        raise AssertionError("candidates as rows")

    texts = [" ".join(f"w{(k * j * j + j) % (7 + k)}" for j in range(60)) for k in range(1, 9)] + ["a b a", "", None, "hub " + " hub ".join(f"x{j % 40}" for j in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = lm.fit(lm.token_table(docs, "id"))
    monkeypatch.setattr(infilling, "candidates", rows)
    places = infilling.masked(docs, "id", 2, share=0.7)
    one = {tuple(r) for r in infilling.fills(places, model, "id").collect()}
    monkeypatch.setattr(infilling, "PAIRS", 60)
    assert len(one) > 100 and {tuple(r) for r in infilling.fills(places, model, "id").collect()} == one


def test_words_are_numbered_in_order_over_partitions(spark, tmp_path):
    from glyphmill.operators import infilling

    words = spark.createDataFrame([(f"w{k * 7919 % 500}é",) for k in range(500)], "t string").repartition(5)
    for folder in (None, f"file://{tmp_path}"):
        found = infilling.numbered(words, folder).collect()
        assert [r.t for r in sorted(found, key=lambda r: r.id)] == sorted({r.t for r in found}) and {r.id for r in found} == set(range(500))


def test_digests_are_compared_without_becoming_numbers(spark):
    """Exchanges and marks choose the places that uniform() < p chooses; the digests of a text's characters are not converted."""
    from glyphmill.functions import rng
    from glyphmill.operators import attacks as A

    rows = spark.range(3000).select(*[((rng.uniform(7, "k", "s", F.col("id")) < p) == rng.under(p, rng.prefix(7, "k", "s"), F.col("id"))).alias(f"c{j}") for j, p in enumerate((0.0, 0.01, 0.5, 0.9999999999, 1.0))])
    assert all(all(r) for r in rows.collect())
    docs = spark.createDataFrame([(1, "abc def 12 " * 40)], "id long, text string")
    for attack in (A.char_swap, A.word_swap):
        assert "conv(" not in docs.select(attack(F.col("text"), F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    flagged = [0, 1, 2, 5, 6, 9, 10, 11, 12]
    items = F.array(*[F.lit(str(k)) for k in range(14)])
    made = spark.range(1).select(A.swapped(items, lambda w, i: i.isin(*flagged))).first()[0]
    assert made == ["1", "0", "3", "2", "4", "6", "5", "7", "8", "10", "9", "12", "11", "13"]


def test_band_is_as_wide_as_what_stays_unmatched(monkeypatch):
    """A text with parts left out needs a band of its unmatched characters, not of all that was left out, on either side."""
    import random

    from glyphmill.functions import fuzz

    draw = random.Random(5)
    a = "".join(draw.choice("abcdefgh ,") for _ in range(20_000))
    b = a[:3000] + a[9000:15_000] + a[16_000:]
    asked, band = [], fuzz.in_band
    monkeypatch.setattr(fuzz, "in_band", lambda a, b, k, *drift: asked.append(k) or band(a, b, k, *drift))
    assert fuzz.common_subsequence(a, b) == fuzz.common_subsequence(b, a) == len(b)
    assert max(asked) <= 400


def test_statistics_of_the_models_own_texts_shuffle_no_token(spark, tmp_path, monkeypatch):
    """Chunks and owners give what joins of tokens give, for every column, in many chunks, with a word like the start and keys that repeat; nothing of the queries' last plan is a join or a window."""
    from glyphmill.operators import coded
    from glyphmill.operators import language_model as lm

    monkeypatch.setattr(coded, "CHUNK", 50)
    texts = [" ".join(f"W{(k * j * j + j) % (7 + k)}" for j in range(60)) for k in range(1, 9)] + ["a b a", "", None, "<s> a <s>", "hub " + " hub ".join(f"x{j % 40}" for j in range(90))]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "id string, text string").repartition(3)
    tokens = lm.token_table(docs, "id")
    columns = ("lp", "lp2", "entropy", "variance", "cross", "best", "rank")
    values = lambda df: {(r.id, r.pos): [round(float(r[c]), 9) for c in columns] for r in df.collect()}
    expected = values(lm.statistics(tokens, lm.fit(tokens, ranked=True), "id", fitted=True))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    found = coded.documents(docs, "id", f"file://{tmp_path}/own", columns)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found.count() == 11 and values(coded.tokens(found, "id", columns)) == expected and len(expected) > 600
    assert spark.read.parquet(f"file://{tmp_path}/own/chunks").count() > 5
    again = coded.documents(docs.union(docs.where("id = 'd8'")), "id", f"file://{tmp_path}/again", ("lp",))
    assert {r.id: r.n for r in again.select("id", F.size("lp").alias("n")).collect()}["d8"] == 6
    assert coded.documents(docs.where("text = ''"), "id", f"file://{tmp_path}/none", columns).count() == 0
    for name in ("detector_imbd", "detector_fastdetectgpt", "repair_auc_h2l"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("value", ["likelihood", "logrank"])
def test_fillings_of_the_models_own_texts_are_scored_by_their_draws(spark, tmp_path, monkeypatch, value):
    """No filled text is made or searched in the model, and the scores are those of the filled texts."""
    from glyphmill.operators import detectors
    from glyphmill.operators import language_model as lm

    texts = [" ".join(f"W{(k * j * j + j) % (7 + k)}" for j in range(60)) for k in range(1, 9)] + ["a b a", "", None, "b", "hub " + " hub ".join(f"x{j % 40}" for j in range(90))]
    docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "id string, text string")
    model = lm.fit(lm.token_table(docs, "id"), f"file://{tmp_path}/model", ranked=True)
    values = lambda df: {r.id: (r.variants, r.difference, r.ratio) for r in df.collect()}
    expected = values(detectors.perturbed(docs, model, "id", value, f"file://{tmp_path}/texts"))

    def made(*_):
        raise AssertionError("filled texts")

    monkeypatch.setattr(detectors.infilling, "filled", made)
    found = values(detectors.perturbed_own(docs, model, "id", value, f"file://{tmp_path}/draws"))
    assert set(found) == set(expected) and len(found) == 11
    assert all(f == pytest.approx(expected[k], abs=2e-6) for k, f in found.items()) and found["d1"][1] != 0


ODD = [None, "", " ", "\n\t", "One. Two!\u2028", "end \u2028", "a b\x0c\x0c\u2029", ".\n! \x85", "one\x01two. three", "\x01 x", "a\u2028b c. d", "no. \n\x01\n more"]


@pytest.mark.parametrize("name", ["sentences", "attack_sentence_deletion", "attack_form_shift_u", "attack_cohesiveness_deletion", "take_first_k", "norm_text_label"])
def test_blank_texts_and_rare_line_ends(spark, tmp_path, name):
    path, c = tables(spark, tmp_path, documents=([(k, t, "en", "web", len(t or "")) for k, t in enumerate(ODD)], DOCS))
    same(QUERIES[name](spark, path), c, ORACLES[name])


def test_words_of_texts_without_latin_ones_are_their_parts(spark, tmp_path):
    texts = ["It's late 5", " 123  45.6\t7! ", "Съешь ещё булок.", "漢字 仮名", "", " ", None]
    path, c = tables(spark, tmp_path, documents=([(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], DOCS))
    told = {r.doc_id: (r.n, r.words) for r in QUERIES["words"](spark, path).collect()}
    assert told == {0: (2, "It's late"), 1: (3, "123 45.6 7!"), 2: (3, "Съешь ещё булок."), 3: (2, "漢字 仮名"), 4: (0, ""), 5: (0, ""), 6: (None, None)}
    same(QUERIES["words"](spark, path), c, ORACLES["words"])


@pytest.mark.parametrize("value", [None, "p"])
def test_fills_in_rounds_leave_draws_only(spark, tmp_path, monkeypatch, value):
    """Draws in rounds of the grid are those of one round, and when they are made their places, lists and shuffle files are gone."""
    from pathlib import Path

    from glyphmill.operators import infilling
    from glyphmill.operators import language_model as lm

    texts = [" ".join(f"w{(k * j * j + 3 * j) % (5 + k)}" for j in range(50)) for k in range(1, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    model = lm.fit(lm.token_table(docs, "id"), f"file://{tmp_path}/model")
    places, more = infilling.masked(docs, "id", 2, share=0.7), {"value": F.ln(value)} if value else {}
    one = {tuple(r) for r in infilling.fills(places, model, "id", **more).collect()}
    monkeypatch.setattr(infilling, "ROUND", 50)
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = held()
    made = infilling.fills(places, model, "id", f"file://{tmp_path}/fills", **more)
    assert held() <= before + 8  # of small counts; each round alone has seven
    assert {tuple(r) for r in made.collect()} == one
    names = {p.name for p in Path(f"{tmp_path}/fills").glob("*/*")}
    assert len([n for n in names if n.startswith("drawn-")]) > 2 and not names & {"places", "after", "before"}


def test_chains_of_earlier_steps_go(spark, tmp_path, monkeypatch):
    """Of a large model's chains, only the last written step's are in the folder, and they are as without a folder."""
    from pathlib import Path

    from glyphmill.operators import generation
    from glyphmill.operators import language_model as lm

    monkeypatch.setattr(generation, "BROADCAST_ROWS", 0)
    texts = [" ".join(f"w{(k * j * j + j) % (7 + k)}" for j in range(30)) for k in range(1, 6)]
    model = lm.fit(lm.token_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id"))
    own = generation.Setting("own", 0.9, 0.95)
    chains = spark.createDataFrame([(f"c{k}", "own", f"w{k}") for k in range(6)], "chain string, setting string, h string")
    told = lambda folder: sorted(map(tuple, generation.generate(chains, generation.guide(model, [own], folder), 3, "chain").select("chain", "made").collect()))
    assert told(f"file://{tmp_path}/written") == told(None)
    assert len([p for p in Path(f"{tmp_path}/written").iterdir() if p.name.startswith("chains-")]) == 1
