"""Small cases with results worked out by hand, and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import normalize as norm
from glyphmill.functions import text
from glyphmill.operators import alignment, attacks, curves, metrics, sampling
from glyphmill.operators import calibration as cal
from glyphmill.sources import readers
from glyphmill.streaming import monitors


@pytest.fixture
def s4(spark):
    return spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.5), (3, 1, 0.5), (4, 0, 0.1)], "id long, y int, prob double")


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_curves(s4):
    assert curves.roc_auc(s4).first().auc == 0.875
    assert curves.roc_auc_ranks(s4).first().auc == 0.875
    assert curves.pr_auc(s4).first().auc == pytest.approx(0.791667)
    swapped = s4.withColumn("id", F.when(F.col("id") == 2, 3).when(F.col("id") == 3, 2).otherwise(F.col("id")))
    assert curves.pr_auc(swapped).first().auc == 1.0
    at = curves.tpr_at_fpr(s4, (0.01,)).first()
    assert (at.threshold, at.tpr, at.fpr, at.acc) == (0.9, 0.5, 0.0, 0.75) and at.f1 == pytest.approx(0.666667)
    assert tuple(curves.best_threshold(s4, "acc").first()) == (0.9, 0.75)
    assert tuple(curves.best_threshold(s4, "f1").first()) == (0.5, 0.8)
    assert [(r.seq, r.coverage, r.risk) for r in curves.risk_coverage(s4).orderBy("coverage").collect()] == [(1, 0.25, 0.0), (4, 0.5, 0.0), (2, 0.75, 0.333333), (3, 1.0, 0.25)]
    single = curves.tpr_at_fpr(s4.where("y = 1")).collect()
    assert len(single) == 5 and all(r.tpr is None for r in single)
    assert curves.roc_auc(s4.where("y = 1")).first().auc is None


def test_calibration_errors(s4):
    r = metrics.ece_brier(s4).first()
    assert (r.ece, r.brier) == (0.05, 0.13)
    assert {b.bin: b.n for b in metrics.reliability_bins(s4).collect()} == {k: {1: 1, 5: 2, 9: 1}.get(k, 0) for k in range(10)}
    bins = metrics.reliability_bins(s4.sparkSession.createDataFrame([(1, 1.0), (1, 0.7), (0, 0.29)], "y int, prob double"))
    assert [b.bin for b in bins.where("n > 0").orderBy("bin").collect()] == [2, 7, 9]


def test_auc_properties(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(rng.random() < 0.4), float(round(rng.random(), 2))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, y int, prob double")
    auc = curves.roc_auc(df).first().auc
    assert curves.roc_auc(df.withColumn("prob", F.exp("prob") * 3)).first().auc == auc
    assert curves.roc_auc(df.withColumn("prob", -F.col("prob"))).first().auc == pytest.approx(1 - auc, abs=1e-6)
    brute = np.mean([(a > b) + 0.5 * (a == b) for _, y, a in rows if y for _, z, b in rows if not z])
    assert auc == pytest.approx(brute, abs=1e-6)
    assert curves.roc_auc(df.repartition(7)).first().auc == auc


def test_platt_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + 1.7 * x)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "s double, y int")
    model = cal.fit_platt(df, "s", "y")
    z = (x - x.mean()) / x.std()
    b = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(b[0] + b[1] * z)))
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[w.sum() + 1e-8, (w * z).sum()], [(w * z).sum(), (w * z * z).sum() + 0.01]])
        b -= np.linalg.solve(h, [(p - y).sum(), ((p - y) * z).sum() + 0.01 * b[1]])
    assert model.beta0 == pytest.approx(b[0], abs=1e-5) and model.beta1 == pytest.approx(b[1], abs=1e-5)
    linear = cal.fit_linear(df.withColumn("x", F.array("s")), "x", "y")
    assert linear.beta == pytest.approx(b.tolist(), abs=1e-3)


def test_text(spark):
    col = F.col("t")
    assert one(spark, F.size(text.sentences(col)), t="Hi there. Ok!\nBye") == 3
    assert one(spark, text.words(col), t="It's state-of-the-art, v2.") == ["It's", "state", "of", "the", "art", "v"]
    assert [one(spark, text.syllables(col), t=w) for w in ("the", "machine", "queue", "rhythm")] == [1, 2, 1, 1]
    r = one(spark, text.readability(col), t="I am.")
    assert (r.reading_ease, r.grade) == (120.205, -3.01)
    empty = one(spark, text.readability(col), t="")
    assert (empty.n_words, empty.reading_ease) == (0, None)
    assert one(spark, text.unicode_word_count(col), t="你好 world-wide 42 don't") == 5
    assert [one(spark, text.length_bucket(col), t=n) for n in (50, 51, 500, 501)] == ["0-50", "50-100", "400-500", ">500"]
    assert one(spark, text.take_first(col, 5), t="a  b c") == "a  b c"
    assert one(spark, text.ngram_overlap(F.split("a", " "), F.split("b", " "), 1), a="a b c d", b="b c x d") == 3


def test_normalisation(spark):
    assert [one(spark, norm.label(F.col("v")), v=v) for v in ("GPT", " Human ", "2", "1.0", "1")] == [1, 0, None, None, 1]
    none = F.lit(None).cast("string")
    assert one(spark, norm.match_key(none, none, none, F.col("i"), F.lit("typo")), i="9-typo-x") == "9"
    assert one(spark, norm.attack_name(none, none, none, F.col("i")), i="uuid-ta_tran-12") == "text_tran"
    rows = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "s double")
    assert cal.finite_rows(rows, "s").count() == 1


def test_attack_success(spark):
    base = spark.createDataFrame([("b1", 1, 0.9), ("b2", 1, 0.9), ("b3", 1, 0.1)], "k string, y int, prob double")
    variants = spark.createDataFrame([("b1", "m", 1, 0.9, 1), ("b1", "m", 1, 0.1, 2), ("b2", "m", 1, 0.9, 3), ("b3", "m", 1, 0.1, 4)], "k string, method string, y int, prob double, seq int")
    r = alignment.attack_success(base, variants).first()
    assert (r.attack_eval_n, r.asr, r.variant_acc, r.base_correct_n) == (2, 0.5, 0.666667, 2)
    assert alignment.pairwise_success(base, variants).first().asr == 0.0
    by = spark.createDataFrame([(0.5, 2, 2), (1.0, 6, 6)], "asr double, attack_eval_n long, base_correct_n long")
    s = alignment.success_summary(by).first()
    assert (s.asr_mean, s.asr_weighted) == (0.75, 0.875)


def test_splits(spark):
    assert [sampling.quotas(n) for n in (10, 7, 3)] == [[8, 1, 1], [5, 1, 1], [3, 0, 0]]
    df = spark.createDataFrame([(c,) for c in "abcdefghij"], "g string")
    got = {r.g: r.split for r in sampling.split(df, "g").collect()}
    assert {g for g, s in got.items() if s == "train"} == set("gcdhaeb" + "i") and got["j"] == "dev" and got["f"] == "test"
    balanced = sampling.balanced(spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "id long, y int"), "id", "y", 2)
    assert sorted(r.y for r in balanced.collect()) == [0, 1]


def test_attacks_do_not_depend_on_partitions(spark):
    rows = [(k, " ".join(f"word{j}" for j in range(k % 40)) + ". The end!") for k in range(60)] + [(60, ""), (61, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    configs = [{"type": t} | ({"table": {"the": "a"}} if t in ("dict_subst", "syno") else {}) | ({"keywords": ["the"]} if t == "selective_deletion" else {}) for t in attacks.ATTACKS]
    run = lambda d: sorted((r.id, r.attack, r.attacked) for r in attacks.attacked(d, configs).collect())
    first = run(df.repartition(1))
    assert first == run(df.repartition(7)) and len({a for _, a, _ in first}) >= 10


def test_swaps_keep_the_words(spark):
    words = [f"w{k}" for k in range(200)]
    out = one(spark, attacks.word_swap(F.col("t"), F.lit("k"), 0.5), t=" ".join(words)).split()
    assert sorted(out) == sorted(words) and out != words
    assert all(abs(int(w[1:]) - k) <= 1 for k, w in enumerate(out))


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": " x ", "label": "human"}\n\n{"article": "y", "label": 1, "extra": [1]}\n{"text": "z", "label": 0.5}\n')
    got = {(r.text, r.label) for r in readers.examples(readers.scan_jsonl(spark, f"file://{tmp_path}/a.jsonl")).collect()}
    assert got == {("x", 0), ("y", 1)}
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception, match="MALFORMED|parse"):
        readers.scan_jsonl(spark, f"file://{tmp_path}/bad.jsonl").collect()
    for name, body, n in (("l", '[{"text": "a", "label": 1}]', 1), ("d", '{"items": [{"text": "a", "label": 1}, {"text": "b", "label": 0}]}', 2), ("o", '{"text": "a", "label": 1}', 1)):
        (tmp_path / f"{name}.json").write_text(body)
        assert readers.examples(readers.scan_json(spark, f"file://{tmp_path}/{name}.json")).count() == n


def test_streams_agree_with_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = monitors.running_means(stream, "value").writeStream.outputMode("complete").format("memory").queryName("means").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").first() == monitors.running_means(events, "value").first()
    q = monitors.drift(stream, "ts", "value", "event_type", late="10000 days").writeStream.outputMode("complete").format("memory").queryName("drift").start()
    q.processAllAvailable()
    q.stop()
    own = spark.table("drift").withColumn("start", F.col("start").cast("timestamp_ntz"))
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, monitors.drift(events, "ts", "value", "event_type").collect()))


def test_priors_of_true_lengths(spark, tmp_path):
    from glyphmill.operators import language_model as lm
    from glyphmill.plans.registry import QUERIES

    lengths = [0, 1, 2, 3, 4, 5, 64, 65, 300, 2001]
    for share in (0.2, 0.5, 0.7):
        got = {r.n: r.prior for r in lm.length_priors(spark.createDataFrame([(n,) for n in lengths], "n int"), share).collect()}
        assert got == pytest.approx({n: lm.length_prior(n, share) for n in lengths}, abs=2e-6)
    spark.createDataFrame([(n, "w " * n, "en", "s", 2 * n) for n in lengths], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n for r in QUERIES["pu_prior_by_length"](spark, f"file://{tmp_path}").collect()} == {n: n for n in lengths}


@pytest.mark.parametrize("hot", [100_000, 3])
def test_lastdepp_is_normalised_by_sampled_sequences(spark, monkeypatch, hot):
    """Over the whole vocabulary, by the same draws; also with frequent histories that are cut."""
    from glyphmill.functions import rng
    from glyphmill.operators import language_model as lm
    from glyphmill.operators import sampled_scores

    monkeypatch.setattr(sampled_scores, "HOT", hot)
    texts = {1: "a b c a b d a c c b a d " * 3 + "e f g", 2: "b a d c " * 8, 3: "a b", 4: "h"}
    docs = spark.createDataFrame([*texts.items(), (5, ""), (6, None)], "id long, text string")
    tokens = lm.token_table(docs, "id")
    model = lm.fit(tokens)
    got = {r.id: r.lastdepp for r in sampled_scores.lastdepp(tokens, model, "id", fitted=True).collect()}
    assert got == {r.id: r.lastdepp for r in sampled_scores.lastdepp(tokens.repartition(7), model, "id").collect()} and set(got) == set(texts)
    q = {r.t: r.q for r in model.unigrams.collect()}
    p = {(r.h, r.t): r.p for r in model.pairs.collect()}
    hashes = {r.id: r.k for r in docs.select("id", F.xxhash64(F.col("id").cast("string"), F.lit("lastdepp")).alias("k")).collect()}
    for key, whole in texts.items():
        t = whole.split()
        h = [lm.START, *t[:-1]]
        values = [sorted([x for (y, _), x in p.items() if y == b], reverse=True) + sorted([(1 - lm.MIX) * q[w] for w in q if (b, w) not in p], reverse=True) for b in h]
        assert [sum(v) for v in values] == pytest.approx([1.0 if len(v) == len(q) else 0.0 for v in values])
        u = sampled_scores.uniforms(np.full(len(t), hashes[key]), np.arange(len(t)), 100, rng.SEED)
        drawn = np.array([[np.log(v[min(np.searchsorted(np.cumsum(v), x, side="right"), len(v) - 1)]) for x in row] for v, row in zip(values, u, strict=True)])
        sampled = [lm.multiscale_entropy(drawn[:, k], 4, 8, 15) for k in range(100)]
        own = lm.multiscale_entropy([np.log(p[x]) for x in zip(h, t, strict=True)], 4, 8, 15)
        assert got[key] == pytest.approx((own - np.mean(sampled)) / (np.std(sampled, ddof=1) or 1), abs=0.02)


def test_lastdepp_in_rounds_is_the_same(spark, monkeypatch, tmp_path):
    """Documents in rounds, each with its samples on the disk alone, have the scores that they have at once."""
    from glyphmill.operators import language_model as lm
    from glyphmill.operators import sampled_scores

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(5 + k % 9))) for k in range(40)] + [(40, "")], "id long, text string")
    tokens = lm.token_table(docs, "id")
    model = lm.fit(tokens, f"file://{tmp_path}/model")
    once = sorted(map(tuple, sampled_scores.lastdepp(tokens, model, "id", fitted=True).collect()))
    monkeypatch.setattr(sampled_scores, "ROUND", 100)
    made = sorted(map(tuple, sampled_scores.lastdepp(tokens, model, "id", fitted=True, folder=f"file://{tmp_path}/rounds").collect()))
    assert made == once and len(made) == 40
    assert len([p for p in (tmp_path / "rounds").glob("*/*") if p.name.startswith("scores-")]) == 4


def test_draws_are_uniform():
    from glyphmill.operators import sampled_scores

    u = sampled_scores.uniforms(np.arange(200) * 7919, np.arange(200), 100, 1)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.25 and len(np.unique(u)) == u.size


def test_statistics_of_unseen_texts_by_brute_force(spark):
    """Every statistic over the whole vocabulary, for seen and unseen pairs, words and histories."""
    from glyphmill.operators import language_model as lm

    rnd = np.random.default_rng(1)
    train = {k: " ".join(rnd.choice(list("aaabbcdefg"), 40)) for k in range(6)} | {9: "z"}
    held = {1: "a b c g z a new a z new new b", 2: "g f e d c b a", 3: "unseen"}
    frame = lambda texts: lm.token_table(spark.createDataFrame(list(texts.items()), "id long, text string"), "id")
    tokens = frame(train)
    model = lm.fit(tokens)
    pairs, single, history = {}, {}, {}
    for t in train.values():
        w = t.split()
        for h, x in zip([lm.START, *w], w, strict=False):
            pairs[h, x] = pairs.get((h, x), 0) + 1
            single[x], history[h] = single.get(x, 0) + 1, history.get(h, 0) + 1
    n, v = sum(single.values()), len(single)
    q = lambda x: (single.get(x, 0) + lm.ALPHA) / (n + lm.ALPHA * v)

    def p(x, h, mix):
        return mix * pairs.get((h, x), 0) / history[h] + (1 - mix) * q(x) if h in history else q(x)

    for texts, fitted in ((train, True), (train, False), (held, False)):
        rows = {(r.id, r.pos): r for r in lm.statistics(frame(texts), model, "id", fitted).collect()}
        assert len(rows) == sum(len(t.split()) for t in texts.values())
        for k, t in texts.items():
            w = t.split()
            for pos, (h, x) in enumerate(zip([lm.START, *w], w, strict=False)):
                all_p = np.array([p(y, h, lm.MIX) for y in single])
                all_p2 = np.array([p(y, h, lm.SECOND_MIX) for y in single])
                entropy = -(all_p * np.log(all_p)).sum()
                own = p(x, h, lm.MIX)
                want = (np.log(own), entropy, (all_p * np.log(all_p) ** 2).sum() - entropy**2, np.log(p(x, h, lm.SECOND_MIX)), (all_p * np.log(all_p2)).sum(), np.log(all_p.max()))
                r = rows[k, pos]
                assert (r.lp, r.entropy, r.variance, r.lp2, r.cross, r.best) == pytest.approx(want, abs=1e-9)
                assert r["rank"] == 1 + (all_p > own).sum()


def test_fuzz_and_rewrite_features(spark):
    from glyphmill.functions import fuzz
    from glyphmill.operators import detectors

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for k, y in enumerate(b):
                row.append(old[k] + 1 if x == y else max(row[-1], old[k + 1]))
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc d"), rng.integers(0, 40))) for _ in range(2))
        assert fuzz.common_subsequence(a, b) == lcs(a, b)
    assert fuzz.ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert fuzz.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert fuzz.token_set_ratio("a b", "a c") == pytest.approx(100 * (1 - 2 / 6))
    texts = {1: "The cat sat. " + "On the mat it lay all day long. " * 4, 2: "x", 3: ""}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = {r.doc_id: [r[n] for n in detectors.REWRITES] for r in detectors.rewrites(df, "doc_id").collect()}
    rows = {r.doc_id: list(r[1:]) for r in detectors.raidar(df, "doc_id").collect()}
    assert {k: len(v) for k, v in rows.items()} == {1: 50, 2: 50, 3: 50}
    assert rows[1] == pytest.approx(fuzz.rewrite_features(texts[1], made[1]), abs=1e-6)
    for k in (2, 3):
        assert rows[k] == pytest.approx(fuzz.rewrite_features(texts[k], made[k]), abs=1e-6)
    own = texts[1].lower().split()
    assert rows[1][32:36] == pytest.approx([len({tuple(own[i : i + n]) for i in range(len(own) - n + 1)} & {tuple(w[i : i + n]) for w in [" ".join(made[1]).lower().split()] for i in range(len(w) - n + 1)}) / len(own) for n in (1, 2, 3, 4)], abs=1e-6)
    assert rows[1][:4] == pytest.approx(np.reshape(rows[1][4:32], (7, 4)).mean(0), abs=1e-6)


def test_likeness_of_long_texts(monkeypatch):
    """Bands give what the whole table gives; a long text with few changes takes time like its length."""
    import random
    import time

    from glyphmill.functions import fuzz

    rnd = random.Random(5)
    monkeypatch.setattr(fuzz, "WHOLE", 8)
    for trial in range(300):
        a = [rnd.choice("abcd") for _ in range(rnd.randrange(1, 120))]
        b = list(a)
        for _ in range(rnd.choice([0, 1, 3, 30, 100])):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(3)] = [rnd.choice("abcde")] * rnd.randrange(3)
        a, b = "".join(a), "".join(b)
        monkeypatch.setattr(fuzz, "BAND", 1 + trial % 9)
        assert fuzz.common_subsequence(a, b) == fuzz.in_band(a, b, max(len(a), len(b), 1)) == fuzz.common_subsequence(b, a)
    monkeypatch.undo()
    words = [f"w{rnd.randrange(5000)}" for _ in range(60_000)]
    other = [w if rnd.random() > 0.002 else "changed" for w in words]
    a, b = " ".join(words), " ".join(other)
    began = time.process_time()
    near = fuzz.common_subsequence(a, b)
    assert time.process_time() - began < 6 and near >= len(a) - 8 * sum(x != y for x, y in zip(words, other, strict=True))


def test_artifacts(spark, tmp_path):
    import json
    import os

    from glyphmill.operators import calibration as cal
    from glyphmill.sources import artifacts

    root = f"file://{tmp_path}"
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_text('{"id": 1, "text": "one", "label": "human"}\n\n{"id": 2, "text": "two", "label": 1}\n')
    (tmp_path / "in/deep/b.json").write_text(json.dumps({"examples": [{"id": 3, "text": "three", "label": "gpt"}]}))
    (tmp_path / "in/deep/c.csv").write_text("ID,Answer,Label\n4,four,0\n")
    (tmp_path / "in/d.txt").write_text("no")
    rows = artifacts.scan_folder(spark, f"{root}/in").collect()
    assert sorted((r.id, r.text, r.label) for r in rows) == [("1", "one", 0), ("2", "two", 1), ("3", "three", 1), ("4", "four", 0)]
    assert artifacts.scan_folder(spark, f"{root}/none") is None and artifacts.latest(spark, f"{root}/none", ".json") is None
    os.environ["GLYPHMILL_T"] = str(tmp_path)
    assert artifacts.resolved("$GLYPHMILL_T/in") == f"{tmp_path}/in" and artifacts.resolved("in/a.jsonl", (str(tmp_path),)) == f"{tmp_path}/in/a.jsonl"
    assert artifacts.resolved("s3://b/k") == "s3://b/k" and artifacts.tag("a b/c:1.0") == "a_b_c_1.0"
    first, other = (artifacts.saved(spark, m, f"{root}/user", d, x).replace("file:///", "file:/") for m, d, x in ((cal.Platt(1.0, 2.0), "rank", "gpt"), (cal.Linear([1.0, 2.0]), "lrr", "m")))
    os.utime(first.removeprefix("file:"), (1, 1))
    find = lambda d, m, **k: artifacts.discovered(spark, d, m, (f"{root}/empty", f"{root}/user"), **k)
    assert find("rank", "none") == (first, cal.Platt(1.0, 2.0)) and find("lrr", "gpt")[1] == cal.Linear([1.0, 2.0])
    assert find("x", "y") is None and find("x", "y", explicit=other)[1] == cal.Linear([1.0, 2.0])
    assert artifacts.latest(spark, f"{root}/user", ".json") == other


def test_calibrators_of_older_layouts(spark, tmp_path):
    """Platt documents with and without a decision, linear ones, and a folder that holds other JSON as well."""
    import json

    from glyphmill.operators import calibration as cal
    from glyphmill.sources import artifacts

    put = lambda name, doc: (tmp_path / name).write_text(doc if isinstance(doc, str) else json.dumps(doc))
    one = {"name": "platt_lr", "beta0": 8.4, "beta1": -14.9, "standardize": True, "mean": -6.2, "std": 3.4, "threshold_raw_p05": -4.2}
    put("rank_gpt-neo-125m_some.train_10000.json", {"calibrator": one | {"decision_mode": "acc", "decision_threshold": 0.13}, "meta": {"detector": "RankDetector[gpt-neo-125m]", "dev": {"num_samples": 4}}})
    put("calibrator_binoculars_GPT-Neo-2.7B_all.jsonl.json", {"calibrator": one | {"std": 0, "decision_boundary_raw_at_prob_0.5": 0.48}, "meta": {"detector": "Binoculars[GPT-Neo-2.7B|GPT-Neo-2.7B]", "dev_eval": {"threshold_prob": 0.4}, "models": {"model1": "/home/x/GPT-Neo-2.7B"}}})
    put("gltr_m.json", {"calibrator": {"name": "linear_lr", "beta": [1, 2, 3], "standardize": True, "mean": [0.5, 0.25], "std": [2, 0], "threshold_raw_p05": None}, "meta": {"detector": "GLTR[m]"}})
    put("plain_m.json", {"calibrator": {"beta": [1.0, 2.0], "standardize": False, "mean": None, "std": None}})
    for name, doc in (("summary.json", {"acc": 1}), ("list.json", [1]), ("broken.json", "{no"), ("empty.json", ""), ("text.json", {"calibrator": "x"}), ("half.json", {"calibrator": {"beta0": 1}, "detector": "rank"})):
        put(name, doc)
    root = f"file://{tmp_path}"
    find = lambda d, m: artifacts.discovered(spark, d, m, (root,))
    assert find("rank", "x")[1] == cal.Platt(8.4, -14.9, -6.2, 3.4, "platt_lr", 0.13)
    assert find("BinocularsDetector", "EleutherAI/GPT-Neo-2.7B")[1] == cal.Platt(8.4, -14.9, -6.2, 1.0, "platt_lr", 0.4)
    assert find("none", "GPT-Neo-2.7B")[0].endswith("all.jsonl.json") and find("gltr", "none")[1] == cal.Linear([1, 2, 3], [0.5, 0.25], [2, 1])
    assert find("plain", "none")[1] == cal.Linear([1.0, 2.0], [0.0], [1.0]) and find("other", "none") is None
    with pytest.raises(ValueError, match="no calibrator"):
        artifacts.loaded(spark, f"{root}/summary.json")
    scored = spark.createDataFrame([(-6.2,)], "s double").select(cal.platt(F.col("s"), find("rank", "x")[1]).alias("p")).first().p
    assert scored == pytest.approx(1 / (1 + math.exp(-8.4)))


def test_parquet_in_folders(spark, tmp_path):
    from glyphmill.sources import artifacts

    spark.createDataFrame([(5, "five", "human", 1.5), (6, "six", "gpt", 2.0)], "id long, text string, label string, more double").coalesce(1).write.parquet(f"file://{tmp_path}/deep/p.parquet")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "one", "label": "human"}\n')
    rows = artifacts.scan_folder(spark, f"file://{tmp_path}").collect()
    assert sorted((r.id, r.text, r.label) for r in rows) == [("1", "one", 0), ("5", "five", 0), ("6", "six", 1)]


def test_samples_with_odd_labels(spark):
    """Null labels are of no class; a third class is as good as the others."""
    rows = [(k, [0, 1, 2, None][k % 4]) for k in range(40)] + [(100, 3), (101, 3)]
    df = spark.createDataFrame(rows, "id long, y int")
    counts = lambda d: dict(sorted((r.y, r["count"]) for r in d.groupBy("y").count().collect()))
    assert counts(sampling.balanced(df, "id", "y", 5)) == {0: 2, 1: 2, 2: 2, 3: 2}
    assert counts(sampling.balanced(df.where("y IS NULL OR y = 1"), "id", "y", 3)) == {1: 6}
    assert sampling.balanced(df.where("y IS NULL"), "id", "y", 3).count() == 0
    dealt = sampling.stratified_exact(df.where("y IS NULL OR y < 2"), "id", "y", 8, 4)
    assert counts(dealt) == {0: 6, 1: 6} and dealt.where("split = 'train'").count() == 8
    empty = sampling.stratified_exact(df.where("y IS NULL"), "id", "y", 8, 4)
    assert empty.count() == 0


@pytest.mark.parametrize("large", [100_000, 1])
def test_pairs_by_the_first_key(spark, monkeypatch, large):
    """The closest key that a row has; rows without any together; all rows where no bucket has both classes; also with places in ranges."""
    monkeypatch.setattr(alignment, "LARGE", large)
    rows = [(1, "q1", "web", 0), (2, "q1", "web", 1), (3, "q1", "web", 1), (4, " ", "web", 0), (5, None, "web", 1), (6, None, "", 0), (7, None, None, 1), (8, "q2", "web", 0), (9, "q1", "web", None), (10, "q1", "web", 5)]
    df = spark.createDataFrame(rows, "k long, question string, source string, y int")
    got = sorted((r.bucket, r.n, r.human, r.machine in (2, 3) if r.human == 1 else r.machine) for r in alignment.paired_by_keys(df, "y", "k").collect() if r.bucket)
    assert got == [("question:q1", 1, 1, True), ("source:web", 1, 4, 5)]
    assert [(r.human, r.machine) for r in alignment.paired_by_keys(df, "y", "k").where("bucket IS NULL").collect()] == [(6, 7)]
    by_source = alignment.paired_by_keys(df.where("k IN (1, 2, 4, 5)"), "y", "k", pair_by="source").collect()
    assert sorted(r.n for r in by_source) == [1, 2] and {r.bucket for r in by_source} == {"source:web"}
    none = alignment.paired_by_keys(df.where("k IN (2, 3, 8)"), "y", "k").collect()
    assert [(r.bucket, r.n, r.human) for r in none] == [(None, 1, 8)] and none[0].machine in (2, 3)
    assert alignment.paired_by_keys(df.where("y = 7"), "y", "k").count() == 0


def test_quota_table(spark):
    df = spark.createDataFrame([(g,) for g, n in (("a", 10), ("b", 7), ("c", 3), (None, 1)) for _ in range(n)], "g string")
    assert {r.g: [r.train, r.dev, r.test] for r in sampling.quota_table(df, "g").collect()} == {g: sampling.quotas(n) for g, n in (("a", 10), ("b", 7), ("c", 3), (None, 1))}


def test_curves_cut_a_score_that_most_rows_share(spark):
    import random

    from glyphmill.operators import ranges

    r = random.Random(3)
    rows = [(k, 0.5 if r.random() < 0.7 else round(r.random(), 3), r.randint(0, 1)) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, prob double, y int").repartition(5)
    parted = ranges.parted(df, "prob", "id", "part", "sub")
    assert parted.where("prob = 0.5").groupBy("part", "sub").count().agg({"count": "max"}).first()[0] < 400
    want, tp, fp = {}, 0, 0
    for k, p, y in sorted(rows, key=lambda x: (-x[1], x[0])):
        tp, fp = tp + y, fp + 1 - y
        want[k] = (tp, fp)
    got = {x.seq: (x.run_tp, x.run_fp) for x in curves.points(df).collect()}
    assert got == want
    places = {x.seq: x.n for x in alignment.numbered(df.select(F.col("id").alias("o"), F.col("id").alias("seq")), "o", "n").collect()}
    assert places == {k: k + 1 for k in range(4000)}


def test_presets_of_mixed_layouts(spark):
    files = [
        ("a", '{"meta": {"dev": {"tpr_at_fpr": {"0.01": {"threshold": 0.9}, "0.05": {"tpr": 1}}, "decision": {"threshold": 0.4, "thresholds": {"acc": 0.3, "f1": {"thr": 0.2}, "tpr": {"threshold": 0.1, "thr": 7}, "odd": "none"}}}}}'),
        ("b", '{"meta": {"dev": {"decision": {"threshold": "0.7"}}}}'),
        ("c", "no document"),
        ("d", None),
        ("e", '{"meta": []}'),
    ]
    got = {(r.file, r.preset): (r.threshold, r.priority) for r in cal.presets(spark.createDataFrame(files, "file string, value string")).collect()}
    assert got == {("a", "tpr@fpr<=0.01"): (0.9, 1), ("a", "acc"): (0.3, 2), ("a", "f1"): (0.2, 2), ("a", "tpr"): (0.1, 2), ("a", "decision"): (0.4, 3), ("b", "decision"): (0.7, 3)}


def test_variants_of_an_attack(spark):
    df = spark.createDataFrame([(1, "some words of a text that is long enough to lose some of its many words"), (2, None), (3, "")], "id long, text string")
    rows = attacks.variants(df, [{"type": "word_drop", "p": 0.3, "variants": 3}, {"type": "homo"}]).collect()
    assert sorted((r.id, r.attack, r.variant) for r in rows) == [(1, "homo", 0), (1, "word_drop", 0), (1, "word_drop", 1), (1, "word_drop", 2)]
    assert len({r.attacked for r in rows}) == 4
    assert attacks.attacked(df, [{"type": "homo"}]).columns == ["id", "text", "attack", "attacked"]


def test_names(spark):
    from glyphmill.operators import language_model as lm
    from glyphmill.plans import names

    assert names.DETECTORS.get("FastDetectGPTDetector") is names.DETECTORS.get("fast_detect_gpt") is names.DETECTORS.get("fastdetectgpt")
    with pytest.raises(KeyError, match="likelihood"):
        names.DETECTORS.get("nothing")
    with pytest.raises(KeyError):
        names.CALIBRATORS.get("")
    names.DETECTORS.register("own")(lambda stats, key: stats.groupBy(key).agg(F.count("*").alias("score")))
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "b a c"), (3, ""), (4, None)], "id long, text string")
    model = names.TRAINERS.get("NGram")(docs)
    assert {r.id: r.score for r in names.scores(docs, "own", model).collect()} == {1: 5, 2: 3}
    likely = {r.id: r.score for r in names.scores(docs, "likelihood", model).collect()}
    assert set(likely) == {1, 2} and likely[1] > likely[2]
    with pytest.raises(KeyError, match="lastdepp.*likelihood.*tocsin"):
        names.scores(docs, "nothing", model)
    long = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 7}" for j in range(30))) for k in range(1, 6)], "id long, text string")
    model = names.train("ngram", long)
    assert {"detectgpt", "dnagpt", "tocsin"} <= set(names.detector_names())
    for name in ("NPR", "LastdePPDetector", "tocsin_fast", "gltr", "raidar"):
        rows = {r.id: r.score for r in names.scores(long, name, model).collect()}
        assert set(rows) == {1, 2, 3, 4, 5} and None not in rows.values(), name
        assert {"gltr": 4, "raidar": 50}.get(name, 0) == (len(rows[1]) if isinstance(rows[1], list) else 0)
    assert tuple(lm.scores()) == lm.SCORES and set(lm.SCORES) <= set(names.DETECTORS.names())
    fit, apply = names.CALIBRATORS.get("platt")
    assert fit is cal.fit_platt and apply is cal.platt


def test_shared_tokens(spark):
    from glyphmill.operators import similarity

    df = spark.createDataFrame([(1, "a b B c", "b a d"), (2, "x", ""), (3, None, None), (4, "Same text", "same TEXT")], "id long, a string, b string")
    got = {r.id: tuple(r)[1:] for r in similarity.shared_tokens(df, "id", "a", "b").collect()}
    assert got == {1: (round(2 / 3, 6), 0.5, round(4 / 7, 6), round(3 / 18**0.5, 6)), 2: (0, 0, 0, 0), 4: (1, 1, 1, 1)}


def test_buffered_log_holds_the_last_lines(spark, tmp_path):
    log = spark.range(60).select((F.col("id") * 7 % 60).alias("n"), F.concat(F.lit("job"), (F.col("id") * 7 % 3).cast("string")).alias("job")).withColumn("line", F.when(F.col("n") != 59, F.concat(F.lit("line "), F.col("n").cast("string"))))
    log = log.withColumn("at", F.timestamp_seconds(F.col("n") + 1.7e9))
    log.repartition(3).write.parquet(f"file://{tmp_path}/log")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/log")
    q = monitors.buffered(stream, "job", "n", "line", "at", keep=5).writeStream.outputMode("update").format("memory").queryName("buffers").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    last = {r.job: r for r in spark.table("buffers").orderBy("seen").collect()}
    want = {}
    for r in monitors.replay(log, "job", "n", 5).orderBy("n").collect():
        want.setdefault(r.job, []).append(r.line or "")
    assert {j: r.lines for j, r in last.items()} == want
    assert {j: r.seen for j, r in last.items()} == dict.fromkeys(want, 20)
