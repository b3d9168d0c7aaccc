"""Detectors of whole texts: those that score variants, rewrites or regenerations of a text beside it.

Each takes texts (key, text) and a fitted model, writes what it needs twice to a folder if one is given, and gives a row for each key that has
tokens. Keys may be of any type that can be a string; rows that repeat a key count as one text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fuzz, text
from . import attacks, coded, generation, infilling
from . import language_model as lm

#: Variants of a text with words filled in anew.
VARIANTS = 3
#: Regenerations of a text's second half, their tokens, the tokens that a text needs, and how they are drawn.
REGENERATIONS, CONTINUED, LEAST_TOKENS, SAMPLED_AS = 3, 20, 20, generation.Setting("dna", 0.7, 0.95)
#: TOCSIN's modes, from the base scores and the share of a text's words that survives deletions.
TOCSIN = {
    "tocsin": "lp * exp(same - 1)",
    "tocsin_fast": "fast * exp(1 - same)",
    "tocsin_lrr": "lp / least(logrank, -CAST(1e-12 AS DOUBLE)) * exp(1 - same)",
    "tocsin_logrank": "least(logrank, -CAST(1e-12 AS DOUBLE)) * exp(same - 1)",
    "tocsin_standalone": "1 - same",
}
REWRITES = ("drop", "swap", "chars", "punct", "typo", "sentences", "blanks")


def filled(docs: DataFrame, model: lm.Model, key: str, folder: str | None = None) -> DataFrame:
    """(key, variant, text, own): VARIANTS fillings of masked words, and the text itself."""
    drawn = infilling.fills(infilling.masked(docs, key, VARIANTS), model, key, folder)
    return infilling.filled(docs, drawn, key, VARIANTS)


def perturbed(docs: DataFrame, model: lm.Model, key: str, value: str, folder: str | None = None) -> DataFrame:
    """(key, variants, difference, ratio) of the mean log-probability (likelihood) or log-rank (logrank) beside those of the fillings."""
    made = filled(docs, model, key, folder).select(key, (F.col("variant") + 1).alias("variant"), "text").unionByName(docs.select(key, F.lit(0).alias("variant"), "text"))
    tokens = lm.token_table(made.select(F.struct(key, "variant").alias("k"), "text"), "k")
    stats = lm.statistics(tokens, model, "k", rank=value == "logrank")
    score = F.avg("lp") if value == "likelihood" else F.avg(F.ln("rank"))
    rows = stats.groupBy("k").agg(score.alias(value)).select("k.*", value)
    return lm.perturbation_score(rows.where("variant = 0").select(key, value), rows.where("variant > 0"), key, value)


def perturbed_own(docs: DataFrame, model: lm.Model, key: str, value: str, folder: str) -> DataFrame:
    """perturbed() of the texts that the model is made of, without their fillings as texts.

    A filling changes two pairs for each place, the drawn word's with its neighbours, and these are in the lists that it was drawn from; so a variant's
    sum is the text's own, less what its places had, and what the draw says they have now.
    """
    import numpy as np
    import pyarrow as pa

    column, name = ("lp", "p") if value == "likelihood" else ("rank", "rank")
    own = coded.documents(docs, key, f"{folder}/own", (column,))
    own = own.select(key, (F.col("lp") if column == "lp" else F.transform("rank", F.ln)).alias("s"))
    drawn = infilling.fills(infilling.masked(docs, key, VARIANTS), model, key, folder, value=F.ln(name))
    drawn = drawn.groupBy(F.col(key).alias("__key")).agg(F.collect_list("variant").alias("variant"), F.collect_list("pos").alias("pos"), F.collect_list("x").alias("x"))
    rows = own.join(drawn, F.col(key) == F.col("__key"), "left").select(key, "s", "variant", "pos", "x")

    def run(batches):
        for b in batches:
            n, lists = b.num_rows, {k: b.column(k) for k in ("s", "variant", "pos", "x")}
            flat = {k: x.flatten().to_numpy() for k, x in lists.items()}
            sizes, many = (lists[k].value_lengths().fill_null(0).to_numpy().astype(int) for k in ("s", "pos"))
            starts, of = np.append(0, np.cumsum(sizes)[:-1]), np.repeat(np.arange(n), many)
            at = starts[of] + flat["pos"]
            total = np.add.reduceat(flat["s"], starts) if n else np.empty(0)
            more = np.bincount(of * VARIANTS + flat["variant"], flat["x"] - (flat["s"][at] + flat["s"][at + 1]), n * VARIANTS).reshape(n, VARIANTS)
            means = (total[:, None] + more) / sizes[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total / sizes), *(pa.array(np.ascontiguousarray(means[:, k])) for k in range(VARIANTS))], names=[key, value, *(f"v{k}" for k in range(VARIANTS))])

    kind = docs.schema[key].dataType.simpleString()
    made = rows.mapInArrow(run, f"`{key}` {kind}, {value} double, " + ", ".join(f"v{k} double" for k in range(VARIANTS)))
    return lm.perturbation_scores(made, key, value, [f"v{k}" for k in range(VARIANTS)])


def dnagpt(docs: DataFrame, model: lm.Model, key: str, folder: str | None = None, fitted: bool = False) -> DataFrame:
    """(key, dnagpt): likelihood of a text less the mean over regenerations of that of its first half and what is sampled after it.

    fitted: the texts are those that the model is made of, so their pairs are its own.
    """
    tokens = lm.token_table(docs, key)
    told = lm.scored_pairs(model, None if fitted else tokens.select("h", "t").distinct()).select("h", "t", F.ln("p").alias("lp"))
    sizes = tokens.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_TOKENS).withColumn("half", F.floor(F.col("n") / 2))
    rows = tokens.join(told, ["h", "t"]).join(sizes, key)
    own = rows.groupBy(key, "half").agg(F.avg("lp").alias("own"), F.sum(F.when(F.col("pos") < F.col("half"), F.col("lp"))).alias("kept"), F.max(F.when(F.col("pos") == F.col("half") - 1, F.col("t"))).alias("h"))
    own = lm._kept(own, folder, "halves")
    ways = own.select(F.col(key).alias("text_key"), F.col("h").alias("h"), F.lit(SAMPLED_AS.name).alias("setting"), F.explode(F.sequence(F.lit(0), F.lit(REGENERATIONS - 1))).alias("way"))
    chains = ways.select(F.concat_ws("-", F.col("text_key").cast("string"), "way").alias("chain"), "text_key", "setting", "h")
    again = generation.generate(chains, generation.guide(model, [SAMPLED_AS], folder), CONTINUED, "chain").select("text_key", F.col("lp").alias("more"))
    mean = F.avg((F.col("kept") + F.col("more")) / (F.col("half") + CONTINUED))
    return again.join(own, F.col("text_key").eqNullSafe(F.col(key))).groupBy(key).agg(F.round(F.max("own") - mean, 6).alias("dnagpt"))


def tocsin(docs: DataFrame, stats: DataFrame, key: str) -> DataFrame:
    """(key, and a column for each mode), scaled by how much of the words survives deletions (the likeness, less one, is at most 0)."""
    own, name = lm.scores(), F.col(key).cast("string")
    cut = docs.select(key, text.split_words(F.col("text")).alias("w"), *[text.split_words(attacks.blank_words(F.col("text"), name, seed=k)).alias(f"v{k}") for k in range(3)])
    same = sum(F.size(f"v{k}") / F.greatest(F.size("w"), F.lit(1)) for k in range(3)) / 3
    base = stats.groupBy(key).agg(own["likelihood"].alias("lp"), own["logrank"].alias("logrank"), own["fastdetectgpt"].alias("fast"))
    return base.join(cut.select(key, same.alias("same")), key).select(key, *[F.round(F.expr(f), 6).alias(n) for n, f in TOCSIN.items()])


def rewrites(docs: DataFrame, key: str) -> DataFrame:
    """(key, text, and a column for each of REWRITES): seven rewrites of each whole text; one that does not apply gives the text."""
    name, t = F.col(key).cast("string"), F.coalesce("text", F.lit(""))
    made = (attacks.word_drop(t, name), attacks.word_swap(t, name), attacks.char_swap(t, name), attacks.punct_noise(t, name), attacks.typo(t, name, "delete"), attacks.drop_sentences(t, name), attacks.blank_words(t, name))
    return docs.select(key, t.alias("text"), *[F.coalesce(r, t).alias(n) for n, r in zip(REWRITES, made, strict=True)])


def raidar(docs: DataFrame, key: str) -> DataFrame:
    """(key, and 50 features) of a text beside its seven rewrites: n-gram overlaps per word (mean, each, all), and both fuzz ratios."""
    names = [f"{r}_{k}" for r in ("mean", *REWRITES, "all") for k in (1, 2, 3, 4)] + [f"{r}_{f}" for r in REWRITES for f in ("ratio", "token_set")]

    def run(batches):
        for b in batches:
            rows = [[round(x, 6) for x in fuzz.rewrite_features(t, list(r))] for t, *r in zip(b.text, *[b[r] for r in REWRITES], strict=True)]
            yield pd.concat([b[[key]], pd.DataFrame(rows, columns=names, index=b.index, dtype=float)], axis=1)

    kind = docs.schema[key].dataType.simpleString()
    return rewrites(docs, key).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"{n} double" for n in names))
