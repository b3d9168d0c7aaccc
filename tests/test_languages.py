"""Language identification: held-out accuracy, scripts, hints, short and odd texts, profiles too large to broadcast."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import languages

TEXTS = {
    "en": ["the cat sat on the mat and looked at the other cat", "there is nothing that the weather would not do to them"],
    "de": ["die katze saß auf der matte und sah die andere katze an", "es gibt nichts was das wetter nicht mit ihnen machen würde"],
    "fr": ["le chat était assis sur le tapis et regardait l'autre chat", "il n'y a rien que le temps ne leur ferait pas subir"],
}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    return languages.counted(spark.createDataFrame([*rows, ("ZH-cn", "这是"), (None, "no language"), (" ", "blank"), ("xx", None), ("yy", "12 34")], "lang string, text string")).persist()


def test_likelihoods_against_brute_force(spark, counts):
    profiles = languages.Profiles(counts)
    own = {}
    for r in counts.collect():
        own.setdefault(r.lang, Counter())[r.gram] = r.n
    assert set(own) == {"en", "de", "fr", "zh"}  # a language without letters has no profile
    v = len({g for c in own.values() for g in c})
    text = "das ist eine neue katze auf der alten matte"
    grams = [f" {text} "[k : k + 3] for k in range(len(text))]
    want = {lang: sum(round(math.log((c[g] + 1) / (c.total() + v)) * 1_000_000) for g in grams) for lang, c in own.items()}
    r = profiles.likelihoods(spark.createDataFrame([(1, text)], "id long, text string"), "id").first()
    first, second = sorted(want.values(), reverse=True)[:2]
    assert (r.grams, r.best, r.first, r.second) == (len(grams), "de", first, second)


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_decisions(spark, counts, monkeypatch, most):
    """The same with profiles that are shuffled."""
    monkeypatch.setattr(languages, "MOST_GRAMS", most)
    rows = {
        1: ("a sentence about the weather and the cat that sat there", None, "en"),
        2: ("ein satz über das wetter und die katze die dort auf der matte saß", None, "de"),
        3: ("une phrase sur le temps et le chat qui était assis sur le tapis", None, "fr"),
        4: ("ein satz über das wetter und die katze die dort auf der matte saß", " ZH-Hant ", "zh"),
        5: ("这是一个关于天气的句子", None, "zh"),
        6: ("это предложение о погоде", None, "ru"),
        7: ("هذه جملة عن الطقس", None, "ar"),
        8: ("short one", None, "en"),
        9: ("12 34 !!", "", "und"),
        10: ("", None, "und"),
        11: (None, None, "und"),
        12: ("die katze saß 这是", None, "en"),
    }
    df = spark.createDataFrame([(k, t, h) for k, (t, h, _) in rows.items()], "id long, text string, hint string")
    got = {r.id: (r.inferred, r.margin) for r in languages.identified(df, languages.Profiles(counts), "id", hint=F.col("hint")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[2] for k, v in rows.items()}
    assert got[2][1] > 0 and got[10][1] is None and got[11][1] is None


def test_no_labelled_texts(spark):
    df = spark.createDataFrame([(1, "a sentence about the weather and the cat that sat there", None)], "id long, text string, lang string")
    profiles = languages.Profiles(languages.counted(df))
    assert languages.identified(df, profiles, "id").select("inferred", "margin").first() == ("en", None)
    assert languages.identified(df.limit(0), profiles, "id").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    profiles = languages.Profiles(languages.counted(docs.where("doc_id % 2 = 0")).persist())
    told = languages.identified(docs.where("doc_id % 2 = 1"), profiles, "doc_id")
    share = {r.lang: r.share for r in told.groupBy("lang").agg(F.avg((F.col("lang") == F.col("inferred")).cast("int")).alias("share")).collect()}
    assert len(share) == 4 and min(share.values()) > 0.95
