"""An n-gram language model as tables, token statistics, and detector scores over them.

p(t | h) = l c(h, t) / c(h) + (1 - l) (c(t) + a) / (N + a V) over all V different tokens of the fitted texts; a token that
they do not have counts 0, and after a history that they do not have p is the second part alone, with l = 0. All moments of a history
are sums over the vocabulary, taken from the sum of its unigram part and corrected for the tokens seen after it, and ranks
are counted from the spectrum of the unigram part (its different values, some square root of the tokens) and corrected likewise,
so no table of histories by vocabulary is made. Tables of any size are joined by shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..session import tidy

UNKNOWN, START = "<unk>", "<s>"
ALPHA, MIX, SECOND_MIX = 0.5, 0.9, 0.5


@dataclass
class Model:
    """pairs (h, t, c, ch, q, p, p2, the moments of h, and rank if asked for), histories (h, ch, entropy, variance, cross, best), unigrams (t, q), and sums over the unigrams."""

    pairs: DataFrame
    histories: DataFrame
    unigrams: DataFrame
    whole: dict[str, float]
    mix: float
    second: float


def token_table(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, pos, t, h): the lower-case words of each text, each with the word before it. No row leaves its task."""
    own = lambda s: F.transform(s["w"], lambda x, i: F.struct(i.alias("pos"), x.alias("t"), F.coalesce(F.get(s["w"], i - 1), F.lit(START)).alias("h")))
    return docs.select(key, F.inline(text.let(own, w=F.transform(text.split_words(F.col(column)), F.lower))))


def bounded(tokens: DataFrame, size: int) -> DataFrame:
    """tokens (of token_table) over the size most frequent ones, ties by token; all others are the unknown one."""
    words = F.broadcast(tokens.groupBy("t").count().orderBy(F.desc("count"), "t").limit(size).select(F.col("t").alias("word")))
    for c in ("t", "h"):
        name = F.when(F.col("word").isNotNull(), F.col(c)).otherwise(F.when(F.col(c) == START, START).otherwise(UNKNOWN) if c == "h" else F.lit(UNKNOWN))
        tokens = tokens.join(words, tokens[c] == words["word"], "left").withColumn(c, name).drop("word")
    return tokens


def _xlogy(x: Column, y: Column) -> Column:
    return x * F.ln(y)


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """df, written to a folder and read again if there is one: computed once, and not lost with an executor."""
    if folder is None:
        return df
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def numbered(words: DataFrame, folder: str | None = None, order: tuple = ("t",), *more: str) -> DataFrame:
    """(t, id, and columns more): different words t with whole numbers from 0, in their order."""
    if folder is None:
        return words.select("t", (F.row_number().over(W.orderBy(*order)) - 1).cast("int").alias("id"), *more)
    own = _kept(words.repartitionByRange(*order).sortWithinPartitions(*order).select("t", *more, F.monotonically_increasing_id().alias("at")), folder, "words")
    part = F.shiftright("at", 33)
    sizes = {r.part: r.n for r in own.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before = [sum(n for k, n in sizes.items() if k < p) for p in range(max(sizes, default=0) + 1)]
    return own.select("t", (F.get(F.array(*map(F.lit, before)), part.cast("int")) + F.col("at") - F.shiftleft(part, 33)).cast("int").alias("id"), *more)


def fit(tokens: DataFrame, folder: str | None = None, mix: float = MIX, second: float = SECOND_MIX, alpha: float = ALPHA, ranked: bool = False) -> Model:
    """The model of tokens, with the ranks of its own pairs if asked for; its tables are written to a folder that driver and executors share,
    or computed where they are used without one."""
    counts = _kept(tokens.groupBy("h", "t").agg(F.count("*").alias("c")), folder, "counts")
    single = counts.groupBy("t").agg(F.sum("c").alias("c"))
    total = single.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    unigrams = _kept(single.select("t", ((F.col("c") + alpha) / (n + alpha * v)).alias("q")), folder, "unigrams")
    q, p = F.col("q"), F.col("p")
    b1, b2 = (1 - mix) * q, (1 - second) * q
    whole = unigrams.agg(F.sum(_xlogy(b1, b1)).alias("e0"), F.sum(b1 * F.ln(b1) * F.ln(b1)).alias("s0"), F.sum(_xlogy(b1, b2)).alias("x0"), F.sum(_xlogy(q, q)).alias("u0"), F.sum(q * F.ln(q) * F.ln(q)).alias("us0"), F.max("q").alias("top_q")).first()
    whole = {k: x or 0.0 for k, x in whole.asDict().items()} | {"no_q": alpha / (n + alpha * v) if n else 0.0}
    # Pairs meet by history once; all that follows from a history's pairs is found there.
    rows = counts.join(unigrams, "t").select("h", "t", "c", "q").repartition("h").sortWithinPartitions("h")
    pairs = _kept(_by_history(rows, unigrams, whole, mix, second, ranked), folder, "pairs")
    histories = pairs.groupBy("h").agg(*[F.max(k).alias(k) for k in ("ch", "entropy", "variance", "cross", "best")])
    return Model(pairs, _kept(histories, folder, "histories"), unigrams, whole, mix, second)


def scored_pairs(model: Model, needed: DataFrame | None = None) -> DataFrame:
    """(h, t, q, p, p2, known, entropy, variance, cross, best) of the model's pairs, or of different pairs (h, t) that it may not have seen."""
    if needed is None:
        return model.pairs.withColumn("known", F.lit(True)).drop("c", "ch")
    rows = needed.join(model.pairs.select("h", "t", "c"), ["h", "t"], "left").join(model.histories, "h", "left").join(model.unigrams, "t", "left")
    none = {k: F.lit(x) for k, x in model.whole.items()}
    known, c, q = F.col("ch").isNotNull(), F.coalesce("c", F.lit(0)), F.coalesce("q", none["no_q"])
    share = lambda mix: F.when(known, mix * c / F.col("ch") + (1 - mix) * q).otherwise(q)
    return rows.select("h", "t", q.alias("q"), share(model.mix).alias("p"), share(model.second).alias("p2"), known.alias("known"), F.coalesce("entropy", -none["u0"]).alias("entropy"), F.coalesce("variance", none["us0"] - none["u0"] * none["u0"]).alias("variance"), F.coalesce("cross", none["u0"]).alias("cross"), F.coalesce("best", none["top_q"]).alias("best"))


def _spectrum(unigrams: DataFrame, mix: float) -> tuple:
    """The different unigram parts, and how many tokens have one as large as each or larger, and 0."""
    import numpy as np

    rows = unigrams.groupBy("q").count().toPandas().sort_values("q")  # the different counts of tokens: some square root of all tokens
    return (1 - mix) * rows["q"].to_numpy(float), np.append(np.cumsum(rows["count"].to_numpy()[::-1])[::-1], 0)


def _whole_histories(batches):
    """Tables of whole histories from batches in the order of h."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = batch.column(0)
        other = np.flatnonzero(pc.not_equal(h, h[-1]).to_numpy(zero_copy_only=False))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut or held and held[-1].column(0)[0] != h[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def moments(c, q, starts, group, whole: dict[str, float], mix: float, second: float) -> tuple:
    """p and p2 of whole histories' pairs, and ch and the moments (entropy, variance, cross, best) of each history; group: the history of each pair."""
    import numpy as np

    ch = np.add.reduceat(c, starts) if len(c) else c
    b1, b2 = (1 - mix) * q, (1 - second) * q
    p, p2 = mix * c / ch[group] + b1, second * c / ch[group] + b2
    moment = lambda x: np.add.reduceat(x, starts) if len(x) else x
    lp, l1 = np.log(p), np.log(b1)
    entropy = -(whole["e0"] + moment(p * lp - b1 * l1))
    told = {
        "entropy": entropy,
        "variance": whole["s0"] + moment(p * lp * lp - b1 * l1 * l1) - entropy * entropy,
        "cross": whole["x0"] + moment(p * np.log(p2) - b1 * np.log(b2)),
        "best": np.maximum(np.maximum.reduceat(p, starts) if len(p) else p, (1 - mix) * whole["top_q"]),
    }
    return p, p2, ch, told


def history_ranks(p, b1, starts, group, values, above):
    """The rank of each of whole histories' pairs, as ranks() has it; values, above: the spectrum of unigram parts.

    After h, a token of the history has some of its tokens above it by p, in place of those above it by their unigram parts; the
    latter are looked for only where one is above the least p.
    """
    import numpy as np

    if not len(p):
        return np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(p)))
    order = np.lexsort((-p, group))
    new = np.ones(len(p), bool)
    new[1:] = (p[order][1:] != p[order][:-1]) | (group[order][1:] != group[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))  # of those of one p
    out = np.empty(len(p), np.int64)
    out[order] = 1 + first - starts[group[order]]
    out += above[np.searchsorted(values, p, side="right")]
    for k in np.flatnonzero(np.maximum.reduceat(b1, starts) > np.minimum.reduceat(p, starts)):
        at = slice(starts[k], starts[k] + sizes[k])
        out[at] -= sizes[k] - np.searchsorted(np.sort(b1[at]), p[at], side="right")
    return out


def _by_history(rows: DataFrame, unigrams: DataFrame, whole: dict[str, float], mix: float, second: float, ranked: bool) -> DataFrame:
    """Pairs (h, t, c, q), dealt and sorted by h, with what their histories make of them, and with rank as ranks() has it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    sent = rows.sparkSession.sparkContext.broadcast(_spectrum(unigrams, mix) if ranked else None)

    def run(batches):
        for own in _whole_histories(batches):
            h = own.column("h")
            c, q = (own.column(k).to_numpy() for k in ("c", "q"))
            new = np.ones(len(c), bool)
            new[1:] = pc.not_equal(h.slice(1), h.slice(0, len(h) - 1)).to_numpy()
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            p, p2, ch, told = moments(c, q, starts, group, whole, mix, second)
            found = {"c": c, "ch": ch[group], "q": q, "p": p, "p2": p2} | {k: x[group] for k, x in told.items()}
            if ranked:
                found["rank"] = history_ranks(p, (1 - mix) * q, starts, group, *sent.value).astype(np.int32)
            yield from pa.table({"h": own.column("h"), "t": own.column("t"), **found}).to_batches(max_chunksize=100_000)

    kind = "h string, t string, c long, ch long, q double, p double, p2 double, entropy double, variance double, cross double, best double"
    return rows.mapInArrow(run, kind + (", rank int" if ranked else ""))


def ranks(pairs: DataFrame, model: Model) -> DataFrame:
    """(h, t, rank) of scored pairs: 1 and the tokens that are more probable after h.

    Tokens above p by their unigram part, from its spectrum; less those of them that h has been seen with, and with those by their own p: a
    running sum over the values of each history.
    """
    import numpy as np

    sent = pairs.sparkSession.sparkContext.broadcast(_spectrum(model.unigrams, model.mix))

    @F.pandas_udf("long")
    def more(x: pd.Series) -> pd.Series:
        values, above = sent.value
        return pd.Series(above[np.searchsorted(values, x.to_numpy(), side="right")])

    own = lambda value, w: model.pairs.select("h", F.lit(None).cast("string").alias("t"), value.alias("x"), F.lit(w).alias("w"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("limit"))
    asked = pairs.select("h", "t", F.col("p").alias("x"), F.lit(0).alias("w"), F.lit(0).alias("kind"), F.when(F.col("known"), F.col("p")).otherwise((1 - model.mix) * F.col("q")).alias("limit"))
    events = asked.unionByName(own(F.col("p"), 1)).unionByName(own((1 - model.mix) * F.col("q"), -1))
    so_far = F.sum("w").over(W.partitionBy("h").orderBy(F.desc("x"), "kind").rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("more", so_far).where("kind = 0").select("h", "t", (1 + F.col("more") + more("limit")).cast("int").alias("rank"))


def statistics(tokens: DataFrame, model: Model, key: str, fitted: bool = False, rank: bool = True) -> DataFrame:
    """(key, pos, lp, entropy, variance, lp2, cross, best, and rank if asked for) of each token; fitted: they are those that the model is made of."""
    pairs = scored_pairs(model, None if fitted else tokens.select("h", "t").distinct())
    told_columns = ("h", "t", F.ln("p").alias("lp"), "entropy", "variance", F.ln("p2").alias("lp2"), "cross", F.ln("best").alias("best"))
    told = pairs.select(*told_columns)
    if rank and "rank" in pairs.columns:
        told = pairs.select(*told_columns, "rank")
    elif rank:
        told = told.join(ranks(pairs, model), ["h", "t"])
    return tokens.join(told, ["h", "t"]).drop("h", "t")


#: Names of scores().
SCORES = ("likelihood", "rank", "logrank", "entropy", "gltr_10", "gltr_100", "gltr_1000", "gltr_rest", "lrr", "fastdetectgpt", "binoculars", "dnadetectllm", "imbd", "causal")


# Detector scores: aggregates of the token statistics of a document.
def scores() -> dict[str, Column]:
    lp, lr = F.avg("lp"), F.avg(F.ln("rank"))
    mean = -F.sum("entropy")
    return {
        "likelihood": lp,
        "rank": -F.avg("rank"),
        "logrank": -lr,
        "entropy": F.avg("entropy"),
        "gltr_10": F.avg((F.col("rank") < 10).cast("double")),
        "gltr_100": F.avg(((F.col("rank") >= 10) & (F.col("rank") < 100)).cast("double")),
        "gltr_1000": F.avg(((F.col("rank") >= 100) & (F.col("rank") < 1000)).cast("double")),
        "gltr_rest": F.avg((F.col("rank") >= 1000).cast("double")),
        "lrr": F.when(lr != 0, -lp / lr).otherwise(0.0),
        "fastdetectgpt": (F.sum("lp") - mean) / (F.sqrt(F.sum("variance")) + 1e-12),
        "binoculars": -lp / (-F.avg("cross") + 1e-12),
        "dnadetectllm": (lp + F.avg("best")) / (2 * F.avg("cross") - 1e-12),
        "imbd": lp - F.avg("lp2"),
        "causal": 1 / (1 - lp),
    }


def needed(names: list[str]) -> tuple[str, ...]:
    """The columns of token statistics that these scores need."""
    of = {"rank": "rank", "logrank": "rank", "entropy": "entropy", "lrr": "lp rank", "fastdetectgpt": "lp entropy variance", "binoculars": "lp cross", "dnadetectllm": "lp cross best", "imbd": "lp lp2"}
    return tuple(sorted({c for n in names for c in of.get(n, "rank" if n.startswith("gltr") else "lp").split()}))


def detector_scores(stats: DataFrame, key: str, names: list[str]) -> DataFrame:
    own = scores()
    missing = {c: F.lit(None).cast("int" if c == "rank" else "double") for c in ("lp", "lp2", "entropy", "variance", "cross", "best", "rank") if c not in stats.columns}
    stats = stats.withColumns(missing) if missing else stats
    return stats.groupBy(key).agg(*[F.round(own[n], 6).alias(n) for n in names])


def strided_perplexity(stats: DataFrame, key: str, stride: int = 256) -> DataFrame:
    """Perplexity from windows of tokens, each weighted by the tokens it scores."""
    per = stats.groupBy(key, F.floor(F.col("pos") / stride).alias("w")).agg(F.sum(-F.col("lp")).alias("nll"), F.count("*").alias("n"))
    return per.groupBy(key).agg(F.round(F.exp(F.sum("nll") / F.sum("n")), 6).alias("perplexity"), F.count("*").alias("windows"))


def repair_curve(stats: DataFrame, key: str, order: str = "s") -> DataFrame:
    """Mean perplexity while tokens are replaced one by one by their best: in sequence (s), or by gain, high to low (h2l) or low to high (l2h)."""
    each = F.array_sort(F.collect_list(F.struct("pos", "lp", "best")))
    return repaired(stats.groupBy(key).agg(each.alias("x")).select(key, F.col("x.lp").alias("lp"), F.col("x.best").alias("best")), key, order)


def repaired(rows: DataFrame, key: str, order: str = "s") -> DataFrame:
    """repair_curve() of rows (key, lp, best) with a document's tokens as arrays, in order: no token leaves its document."""
    sign = {"s": 0.0, "h2l": -1.0, "l2h": 1.0}[order]
    gains = F.zip_with("lp", "best", lambda lp, best: best - lp)
    each = F.transform(gains, lambda g, i: F.struct((sign * F.round(g, 9)).alias("by"), i.alias("pos"), g.alias("gain")))

    def mean(s: Column) -> Column:
        step = lambda done, x: F.struct((done["run"] + x["gain"]).alias("run"), (done["ppl"] + F.exp((s["own"] - done["run"] - x["gain"]) / s["n"])).alias("ppl"))
        return F.aggregate(s["x"], F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("ppl")), step)["ppl"] / s["n"]

    made = text.let(mean, x=F.array_sort(each) if sign else each, own=-F.aggregate("lp", F.lit(0.0), lambda a, x: a + x), n=F.size("lp"))
    return rows.select(key, F.round(made, 6).alias("mean_ppl"))


def multiscale_entropy(lps: list[float], embed: int = 3, factor: int = 10, scales: int = 5) -> float:
    """Mean log-probability over the sample deviation, across scales, of the entropy of consecutive windows' cosines; 0 with one scale or none."""
    import numpy as np

    x, out = np.asarray(lps, float), []
    for scale in range(1, scales + 1):
        n = len(x) - scale + 1
        if n < embed + 1:
            break
        coarse = np.convolve(x, np.ones(scale) / scale, "valid")
        orbit = np.lib.stride_tricks.sliding_window_view(coarse, embed)
        norm = np.linalg.norm(orbit, axis=1)
        both = norm[:-1] * norm[1:]
        cos = np.divide((orbit[:-1] * orbit[1:]).sum(1), both, out=np.zeros(len(both)), where=both > 0)
        bins = max(2, factor * len(x))
        p = np.unique(np.minimum(((np.clip(cos, -1, 1) + 1) / 2 * bins).astype(int), bins - 1), return_counts=True)[1] / len(cos)
        out.append(float(-(p * np.log(p)).sum() / np.log(bins)))
    sd = float(np.std(out, ddof=1)) if len(out) > 1 else 0.0
    return float(np.mean(x)) / sd if len(x) and sd > 0 else 0.0


def lastde(stats: DataFrame, key: str, embed: int = 3, factor: int = 10, scales: int = 5) -> DataFrame:
    """The multiscale score of each document's sequence of log-probabilities."""
    rows = stats.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lp"))), lambda x: x["lp"]).alias("lp"))
    return lastdes(rows, key, embed, factor, scales)


def lastdes(rows: DataFrame, key: str, embed: int = 3, factor: int = 10, scales: int = 5) -> DataFrame:
    """lastde() of rows (key, lp) with a document's log-probabilities as an array, in order."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({key: b[key], "lastde": [round(multiscale_entropy(x, embed, factor, scales), 6) for x in b.lp]})

    return rows.select(key, "lp").mapInPandas(run, f"`{key}` {kind}, lastde double")


def multiscale_entropies(x, embed: int, factor: int, scales: int):
    """multiscale_entropy of each column of an array of sequences of one length."""
    import numpy as np

    length, width = x.shape
    out, bins = [], max(2, factor * length)
    total = np.concatenate([np.zeros((1, width)), np.cumsum(x, 0)])
    for scale in range(1, scales + 1):
        if length - scale + 1 < embed + 1:
            break
        coarse = (total[scale:] - total[:-scale]) / scale
        n = len(coarse) - embed + 1
        norm = np.sqrt(sum(coarse[k : k + n] ** 2 for k in range(embed)))
        dot = sum(coarse[k : k + n - 1] * coarse[k + 1 : k + n] for k in range(embed))
        both = norm[:-1] * norm[1:]
        cos = np.divide(dot, both, out=np.zeros(both.shape), where=both > 0)
        cell = np.minimum(((np.clip(cos, -1, 1) + 1) / 2 * bins).astype(np.int64), bins - 1) + bins * np.arange(width)
        found, counts = np.unique(cell, return_counts=True)
        p = counts / (n - 1)
        out.append(np.bincount(found // bins, -p * np.log(p), width) / np.log(bins))
    sd = np.std(out, axis=0, ddof=1) if len(out) > 1 else np.zeros(width)
    return np.divide(x.mean(0) if length else np.zeros(width), sd, out=np.zeros(width), where=sd > 0)


def perturbation_score(original: DataFrame, perturbed: DataFrame, key: str, value: str) -> DataFrame:
    """(own - mean of perturbed) / (deviation + 1e-8), and own over the mean."""
    per = perturbed.groupBy(key).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.count("*").alias("variants"))
    return _beside_mean(original.join(per, key), key, value)


def perturbation_scores(rows: DataFrame, key: str, value: str, perturbed: list[str]) -> DataFrame:
    """perturbation_score() of rows that have their perturbed values as columns."""
    m = sum(map(F.col, perturbed)) / len(perturbed)
    sd = F.sqrt(sum(F.pow(F.col(c) - m, 2) for c in perturbed) / len(perturbed))
    return _beside_mean(rows.select(key, value, F.lit(len(perturbed)).cast("long").alias("variants"), m.alias("m"), sd.alias("sd")), key, value)


def _beside_mean(rows: DataFrame, key: str, value: str) -> DataFrame:
    return rows.select(key, "variants", F.round((F.col(value) - F.col("m")) / (F.col("sd") + 1e-8), 6).alias("difference"), F.round(F.when(F.col(value) != 0, F.col("m") / F.col(value)).otherwise(1.0), 6).alias("ratio"))


def divergence(tokens: DataFrame, token: str, side: str) -> DataFrame:
    """Jensen-Shannon divergence (in nats) of the token frequencies of two sides, 0 and 1."""
    c = tokens.groupBy(token).agg(*[F.sum((F.col(side) == y).cast("double")).alias(f"c{y}") for y in (0, 1)])
    rows = c.crossJoin(F.broadcast(c.agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1")))).select((F.col("c0") / F.col("n0")).alias("p"), (F.col("c1") / F.col("n1")).alias("r"))
    m = (F.col("p") + F.col("r")) / 2
    part = lambda x: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    return rows.agg(F.round(F.sum(part(F.col("p")) + part(F.col("r"))) / 2, 6).alias("jsd"))


def length_prior(length: int, share: float) -> float:
    """Expected share of human tokens after length steps of a walk on 0 .. length that goes down with a chance share, else up, and stays at the ends."""
    import numpy as np

    if length < 3:
        return share
    at = np.zeros(length + 1)
    at[0] = 1.0
    for _ in range(length):
        down, up = share * at, (1 - share) * at
        at = np.append(down[1:], 0.0) + np.insert(up[:-1], 0, 0.0)
        at[0] += down[0]
        at[-1] += up[-1]
    return float(1 - at @ np.arange(length + 1) / length)


def length_priors(lengths: DataFrame, share: float) -> DataFrame:
    """(n, prior) of lengths (n): length_prior() of each, rounded.

    The walk cannot pass its upper end, so one walk serves all lengths: its mean grows by 1 - share, less share unless it is at 0, where it
    is until it first goes above; that happens after 2 m + 1 steps with the chance Catalan(m) (1 - share)^(m + 1) share^m.
    """
    import numpy as np

    def run(batches):
        for b in batches:
            k = int(b.n.max()) + 2 if len(b) else 2
            m = np.arange(1, k // 2 + 1)
            leaves = np.zeros(k + 2)
            terms = np.cumprod(np.append(1 - share, share * (1 - share) * 2 * (2 * m - 1) / (m + 1)))
            leaves[1::2] = terms[: len(leaves[1::2])]
            mean = np.append(0.0, np.cumsum((1 - share) - share * np.minimum(1.0, np.cumsum(leaves))))
            n = b.n.to_numpy()
            yield b.assign(prior=np.round(np.where(n < 3, share, 1 - mean[n] / np.maximum(n, 1)), 6))

    return lengths.select("n").mapInPandas(run, "n int, prior double")
