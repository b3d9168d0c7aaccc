"""Queries for the language model, detectors, neighbours, graphs and streams."""

from __future__ import annotations

import hashlib
from functools import cache

import pandas as pd
from pyspark.sql import functions as F

from ..functions import fuzz, rng, text
from ..operators import attacks, calibration, classifier, coded, detectors, generation, graph, neighbours, sampled_scores, sampling, similarity
from ..operators import language_model as lm
from ..operators.generation import Setting
from ..streaming import monitors
from .base import ORACLES, SCORED, query, scored, table, uniform_sql, written
from .text_queries import SENT, WORDS, docs

def fitted(spark, tokens, ranked: bool = False):
    return lm.fit(tokens, written(spark, "model"), ranked=ranked)


def documents(spark, d, *columns: str):
    """The statistics of each document's tokens, as arrays, under the model of all documents."""
    return coded.documents(docs(spark, d).select("doc_id", "text"), "doc_id", written(spark, "statistics"), columns)


def statistics(spark, d, *columns: str):
    return coded.tokens(documents(spark, d, *columns), "doc_id", columns)


def _tokens(name: str, source: str, key: str = "doc_id") -> str:
    return f"{name} AS (SELECT {key}, i - 1 AS pos, lower(w[i]) AS t, CASE WHEN i = 1 THEN '<s>' ELSE lower(w[i - 1]) END AS h FROM (SELECT {key}, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT {key}, {WORDS} AS w FROM {source})))"


_B1, _B2 = "(1 - CAST(0.9 AS DOUBLE)) * q", "(1 - CAST(0.5 AS DOUBLE)) * q"
_MODEL = f"""pr AS (SELECT h, t, count(*) AS c FROM cd GROUP BY h, t), un AS (SELECT t, sum(c) AS c FROM pr GROUP BY t), tot AS (SELECT sum(c) AS n, count(*) AS v FROM un),
q AS (SELECT t, (c + CAST(0.5 AS DOUBLE)) / (n + CAST(0.5 AS DOUBLE) * v) AS q FROM un, tot),
wh AS (SELECT sum({_B1} * ln({_B1})) AS e0, sum({_B1} * ln({_B1}) * ln({_B1})) AS s0, sum({_B1} * ln({_B2})) AS x0, sum(q * ln(q)) AS u0, sum(q * ln(q) * ln(q)) AS us0, max(q) AS top_q, (SELECT CAST(0.5 AS DOUBLE) / (n + CAST(0.5 AS DOUBLE) * v) FROM tot) AS no_q FROM q),
hs AS (SELECT h, sum(c) AS ch FROM pr GROUP BY h),
se AS (SELECT h, t, c, ch, q, CAST(0.9 AS DOUBLE) * c / ch + {_B1} AS p, CAST(0.5 AS DOUBLE) * c / ch + {_B2} AS p2 FROM pr JOIN hs USING (h) JOIN q USING (t)),
mo AS (SELECT h, ch, entropy, sq - entropy * entropy AS variance, crossed, greatest(top, (1 - CAST(0.9 AS DOUBLE)) * top_q) AS best FROM (SELECT h, any_value(ch) AS ch, any_value(top_q) AS top_q, -(any_value(e0) + sum(p * ln(p) - {_B1} * ln({_B1}))) AS entropy, any_value(s0) + sum(p * ln(p) * ln(p) - {_B1} * ln({_B1}) * ln({_B1})) AS sq, any_value(x0) + sum(p * ln(p2) - {_B1} * ln({_B2})) AS crossed, max(p) AS top FROM se, wh GROUP BY h)),
sp AS (SELECT b, sum(k) OVER (ORDER BY b DESC) AS above FROM (SELECT {_B1} AS b, count(*) AS k FROM q GROUP BY 1))"""


def _scores(tokens: str, key: str = "doc_id") -> str:
    return f"""nd AS (SELECT DISTINCT h, t FROM {tokens}),
nq AS (SELECT nd.h, nd.t, coalesce(c, 0) AS c, ch, coalesce(q.q, no_q) AS q, coalesce(entropy, -u0) AS entropy, coalesce(variance, us0 - u0 * u0) AS variance, coalesce(crossed, u0) AS crossed, coalesce(best, top_q) AS best FROM nd LEFT JOIN pr ON nd.h = pr.h AND nd.t = pr.t LEFT JOIN mo ON nd.h = mo.h LEFT JOIN q ON nd.t = q.t, wh),
np AS (SELECT *, CASE WHEN ch IS NULL THEN q ELSE CAST(0.9 AS DOUBLE) * c / ch + {_B1} END AS p, CASE WHEN ch IS NULL THEN q ELSE CAST(0.5 AS DOUBLE) * c / ch + {_B2} END AS p2 FROM nq),
ev AS (SELECT h, t, p AS x, 0 AS w, 0 AS kind FROM np UNION ALL SELECT h, NULL, p, 1, 1 FROM se UNION ALL SELECT h, NULL, {_B1}, -1, 1 FROM se),
dr AS (SELECT h, t, d FROM (SELECT h, t, kind, sum(w) OVER (PARTITION BY h ORDER BY x DESC, kind ROWS UNBOUNDED PRECEDING) AS d FROM ev) WHERE kind = 0),
ab AS (SELECT l.h, l.t, coalesce(above, 0) AS above FROM (SELECT h, t, CASE WHEN ch IS NULL THEN {_B1} ELSE p END AS l FROM np) l ASOF LEFT JOIN sp ON l.l < sp.b),
st AS (SELECT {key}, pos, ln(p) AS lp, 1 + above + d AS rk, entropy, variance, ln(p2) AS lp2, crossed, ln(best) AS best FROM {tokens} JOIN np USING (h, t) JOIN dr USING (h, t) JOIN ab USING (h, t))"""


_LM = f"{_tokens('cd', 'documents')}, {_MODEL}, {_scores('cd')}"
_FORMS = {
    "likelihood": {"likelihood": "avg(lp)"},
    "rank": {"rank": "-avg(rk)"},
    "logrank": {"logrank": "-avg(ln(rk))"},
    "entropy": {"entropy": "avg(entropy)"},
    "gltr": {"gltr_10": "avg(CASE WHEN rk < 10 THEN 1 ELSE 0 END)", "gltr_100": "avg(CASE WHEN rk >= 10 AND rk < 100 THEN 1 ELSE 0 END)", "gltr_1000": "avg(CASE WHEN rk >= 100 AND rk < 1000 THEN 1 ELSE 0 END)", "gltr_rest": "avg(CASE WHEN rk >= 1000 THEN 1 ELSE 0 END)"},
    "lrr": {"lrr": "CASE WHEN avg(ln(rk)) <> 0 THEN -avg(lp) / avg(ln(rk)) ELSE 0 END"},
    "fastdetectgpt": {"fastdetectgpt": "(sum(lp) + sum(entropy)) / (sqrt(sum(variance)) + 1e-12)"},
    "binoculars": {"binoculars": "-avg(lp) / (-avg(crossed) + 1e-12)"},
    "dnadetectllm": {"dnadetectllm": "(avg(lp) + avg(best)) / (2 * avg(crossed) - 1e-12)"},
    "imbd": {"imbd": "avg(lp) - avg(lp2)"},
    "causal": {"causal": "1 / (1 - avg(lp))"},
}
for _name, _forms in _FORMS.items():
    query(f"detector_{_name}", f"WITH {_LM} SELECT doc_id, " + ", ".join(f"round({f}, 6) AS {n}" for n, f in _forms.items()) + " FROM st GROUP BY doc_id")(lambda s, d, n=list(_forms): lm.detector_scores(statistics(s, d, *lm.needed(n)), "doc_id", n))
query("token_statistics", f"WITH {_LM} SELECT doc_id, CAST(pos AS INT) AS pos, round(lp, 6) AS lp, CAST(rk AS INT) AS rank FROM st")(lambda s, d: statistics(s, d, "lp", "rank").select("doc_id", "pos", F.round("lp", 6).alias("lp"), F.col("rank").cast("int").alias("rank")))
query("ppl_strided", f"WITH {_LM} SELECT doc_id, round(exp(-sum(lp) / count(*)), 6) AS perplexity, count(DISTINCT pos // 256) AS windows FROM st GROUP BY doc_id")(lambda s, d: lm.strided_perplexity(statistics(s, d, "lp"), "doc_id"))
for _order, _by in (("s", "pos"), ("h2l", "round(best - lp, 9) DESC, pos"), ("l2h", "round(best - lp, 9), pos")):
    query(f"repair_auc_{_order}", f"WITH {_LM} SELECT doc_id, round(avg(ppl), 6) AS mean_ppl FROM (SELECT doc_id, exp(-(sum(lp) OVER (PARTITION BY doc_id) + sum(best - lp) OVER (PARTITION BY doc_id ORDER BY {_by} ROWS UNBOUNDED PRECEDING)) / count(*) OVER (PARTITION BY doc_id)) AS ppl FROM st) GROUP BY doc_id")(lambda s, d, o=_order: lm.repaired(documents(s, d, "lp", "best"), "doc_id", o))
# Scale by scale: means of runs of tokens, the cosines of consecutive windows of three, their histogram and its entropy.
_COS = "(a * b + b * c + c * e) / (sqrt(a * a + b * b + c * c) * sqrt(b * b + c * c + e * e))"
_LASTDE = f"""m AS (SELECT doc_id, pos, lp, scale, count(*) OVER w AS held, sum(lp) OVER w / scale AS x, count(*) OVER (PARTITION BY doc_id, scale) AS n FROM st, (SELECT unnest([1, 2, 3, 4, 5]) AS scale) WINDOW w AS (PARTITION BY doc_id, scale ORDER BY pos ROWS BETWEEN CURRENT ROW AND scale - 1 FOLLOWING)),
o AS (SELECT doc_id, scale, n, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c, lead(x, 3) OVER v AS e FROM m WHERE held = scale WINDOW v AS (PARTITION BY doc_id, scale ORDER BY pos)),
b AS (SELECT doc_id, scale, n, least(floor((greatest(-1, least(1, {_COS})) + 1) / 2 * greatest(2, 10 * n)), greatest(2, 10 * n) - 1) AS bin FROM o WHERE e IS NOT NULL),
h AS (SELECT doc_id, scale, any_value(n) AS n, count(*) AS k FROM b GROUP BY doc_id, scale, bin),
en AS (SELECT doc_id, scale, -sum(k / t * ln(k / t)) / ln(greatest(2, 10 * any_value(n))) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY doc_id, scale) AS t FROM h) GROUP BY doc_id, scale),
sd AS (SELECT doc_id, stddev_samp(entropy) AS sd FROM en GROUP BY doc_id)"""
query("lastde", f"WITH {_LM}, {_LASTDE} SELECT doc_id, round(CASE WHEN sd > 0 THEN lp / sd ELSE 0 END, 6) AS lastde FROM (SELECT doc_id, avg(lp) AS lp FROM st GROUP BY doc_id) LEFT JOIN sd USING (doc_id)")(lambda s, d: lm.lastdes(documents(s, d, "lp"), "doc_id"))
query("lastdepp")(lambda s, d: _lastdepp(s, d))


def _lastdepp(spark, d):
    tokens = lm.token_table(docs(spark, d).select("doc_id", "text"), "doc_id")
    return sampled_scores.lastdepp(tokens, fitted(spark, tokens), "doc_id", fitted=True, folder=written(spark, "lastdepp"))


VARIANTS, REGENERATIONS, CONTINUED = detectors.VARIANTS, detectors.REGENERATIONS, detectors.CONTINUED


def _beside(f, ranked: bool = False):
    """A query of a detector of whole texts, f(texts, model, key, folder)."""

    def run(spark, d):
        rows = docs(spark, d).select("doc_id", "text")
        return f(rows, fitted(spark, lm.token_table(rows, "doc_id"), ranked), "doc_id", written(spark, "detector"))

    return run


# Words in the middle of blocks of three, drawn from those seen between their neighbours.
_FILLED = f"""bw AS (SELECT doc_id, w FROM (SELECT doc_id, {WORDS} AS w FROM documents) WHERE len(w) >= 3),
mk AS (SELECT doc_id, variant, CAST(b * 3 + 1 AS INT) AS pos, lower(w[b * 3 + 1]) AS l, lower(w[b * 3 + 3]) AS r FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) // 3 - 1)) AS b FROM bw), range({VARIANTS}) v(variant) WHERE {uniform_sql("'114514'", "CAST(doc_id AS VARCHAR)", "'mask'", "CAST(variant AS VARCHAR)", "CAST(b AS VARCHAR)")} < 0.3),
ca AS (SELECT x.l, x.r, a.t AS v, greatest(CAST(round(a.c * b.c / ch * 1048576) AS BIGINT), 1) AS w FROM (SELECT DISTINCT l, r FROM mk) x JOIN pr a ON a.h = x.l JOIN pr b ON b.h = a.t AND b.t = x.r JOIN hs ON hs.h = a.t),
ci AS (SELECT l, r, v, sum(w) OVER (PARTITION BY l, r ORDER BY v ROWS UNBOUNDED PRECEDING) AS hi, w, sum(w) OVER (PARTITION BY l, r) AS size FROM ca),
fi AS (SELECT doc_id, variant, pos, v FROM (SELECT *, {uniform_sql("'114514'", "CAST(doc_id AS VARCHAR)", "'fill'", "CAST(variant AS VARCHAR)", "CAST(pos AS VARCHAR)")} AS u FROM mk) m JOIN ci USING (l, r) WHERE hi - w <= floor(u * size) AND floor(u * size) < hi),
ft AS (SELECT doc_id, variant, string_agg(coalesce(v, x), ' ' ORDER BY pos) AS text FROM (SELECT doc_id, variant, unnest(w) AS x, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos FROM bw, range({VARIANTS}) v(variant) WHERE EXISTS (SELECT 1 FROM fi WHERE fi.doc_id = bw.doc_id AND fi.variant = v.variant)) LEFT JOIN fi USING (doc_id, variant, pos) GROUP BY doc_id, variant)"""
_PERTURBED = f"{_tokens('cd', 'documents')}, {_MODEL}, {_FILLED}, va AS (SELECT doc_id, 0 AS variant, text FROM documents UNION ALL SELECT doc_id, n.variant + 1, coalesce(ft.text, documents.text) FROM documents CROSS JOIN range({VARIANTS}) n(variant) LEFT JOIN ft USING (doc_id, variant)), {_tokens('vt', 'va', 'doc_id, variant')}, {_scores('vt', 'doc_id, variant')}"
_AGAINST = "sc AS (SELECT doc_id, variant, {0} AS s FROM st GROUP BY doc_id, variant), ag AS (SELECT doc_id, avg(s) AS m, stddev_pop(s) AS sd, count(*) AS variants FROM sc WHERE variant > 0 GROUP BY doc_id), ow AS (SELECT doc_id, s FROM sc WHERE variant = 0)"
query("detector_detectgpt", f"WITH {_PERTURBED}, {_AGAINST.format('avg(lp)')} SELECT doc_id, variants, round((s - m) / (sd + 1e-8), 6) AS detectgpt FROM ow JOIN ag USING (doc_id)")(_beside(lambda *a: detectors.perturbed_own(*a[:3], "likelihood", a[3]).select("doc_id", "variants", F.col("difference").alias("detectgpt"))))
query("detector_npr", f"WITH {_PERTURBED}, {_AGAINST.format('avg(ln(rk))')} SELECT doc_id, variants, round(CASE WHEN s <> 0 THEN m / s ELSE 1 END, 6) AS npr FROM ow JOIN ag USING (doc_id)")(_beside(lambda *a: detectors.perturbed_own(*a[:3], "logrank", a[3]).select("doc_id", "variants", F.col("ratio").alias("npr")), True))
query("attack_span_fill", f"WITH {_tokens('cd', 'documents')}, {_MODEL}, {_FILLED} SELECT doc_id, CAST(variant AS INT) AS variant, ft.text AS attacked FROM ft JOIN documents USING (doc_id) WHERE ft.text <> documents.text")(lambda s, d: span_fill(s, d))


def span_fill(spark, d):
    """Every document with masked words filled in from the model; unchanged ones are left out."""
    rows = docs(spark, d).select("doc_id", "text")
    made = detectors.filled(rows, fitted(spark, lm.token_table(rows, "doc_id")), "doc_id", written(spark, "fills"))
    attacked = text.let(lambda s: F.when(s["new"] != s["own"], s["new"]), new=F.col("text"), own=F.col("own"))  # a filter on the new text would make it twice
    return made.where("doc_id IS NOT NULL").select("doc_id", "variant", F.explode(F.array_compact(F.array(attacked))).alias("attacked"))


_BLANKS = " + ".join("1 - len(list_distinct(list_transform(generate_series(1, CAST(greatest(1, round_even(n * 0.015, 0)) AS BIGINT)), lambda k: CAST(floor(" + uniform_sql(f"'{k}'", "CAST(doc_id AS VARCHAR)", "'blank'", "CAST(k AS VARCHAR)") + " * n) AS INT)))) / n" for k in range(3))
query("detector_tocsin", f"WITH {_LM}, sa AS (SELECT doc_id, ({_BLANKS}) / 3 AS same FROM (SELECT doc_id, len({WORDS}) AS n FROM documents) WHERE n > 0), sc AS (SELECT doc_id, avg(lp) AS lp, -avg(ln(rk)) AS logrank, {_FORMS['fastdetectgpt']['fastdetectgpt']} AS fast FROM st GROUP BY doc_id) SELECT doc_id, " + ", ".join(f"round({f}, 6) AS {n}" for n, f in detectors.TOCSIN.items()) + " FROM sc JOIN sa USING (doc_id)")(lambda s, d: detectors.tocsin(docs(s, d), statistics(s, d, *lm.needed(["likelihood", "logrank", "fastdetectgpt"])), "doc_id"))
query("detector_raidar")(lambda s, d: detectors.raidar(docs(s, d), "doc_id"))


# Texts from the model: kept candidates as intervals of whole numbers, and a keyed draw for each chain and step.
def _nucleus(settings) -> str:
    rows = ", ".join(f"('{s.name}', CAST('{float(s.temperature)!r}' AS DOUBLE), CAST('{float(s.top_p)!r}' AS DOUBLE))" for s in settings)
    return f"""sg(setting, temperature, top_p) AS (VALUES {rows}), cm AS (SELECT h, max(c) AS most, first(t ORDER BY c DESC, t) AS best FROM se GROUP BY h),
wn AS (SELECT setting, top_p, h, t, c, ln(p) AS lp, CASE WHEN temperature <= 0 THEN CASE WHEN t = best THEN 1 ELSE 0 END ELSE CAST(round(pow(c / most, 1 / nullif(temperature, 0)) * 4294967296) AS BIGINT) END AS w FROM se JOIN cm USING (h), sg),
kn AS (SELECT setting, h, t, lp, hi - w AS lo, hi FROM (SELECT *, sum(w) OVER (PARTITION BY setting, h ORDER BY c DESC, t ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER (PARTITION BY setting, h) AS whole FROM wn WHERE w > 0) WHERE hi - w < top_p * whole),
zn AS (SELECT setting, h, max(hi) AS size FROM kn GROUP BY ALL)"""


def _chains(start: str, steps: int, key: str) -> str:
    """Recursive SQL: start gives (doc_id, way, setting, h)."""
    u = uniform_sql("'114514'", key, "ch.setting", "CAST(k AS VARCHAR)")
    return f"""ch(doc_id, way, setting, h, made, lp, k) AS (SELECT doc_id, way, b.setting, CASE WHEN zn.h IS NULL THEN '<s>' ELSE b.h END, '', CAST(0 AS DOUBLE), 0 FROM ({start}) b LEFT JOIN zn ON zn.setting = b.setting AND zn.h = b.h
UNION ALL SELECT ch.doc_id, ch.way, ch.setting, CASE WHEN nx.h IS NULL THEN '<s>' ELSE kn.t END, ch.made || CASE WHEN k = 0 THEN '' ELSE ' ' END || kn.t, ch.lp + kn.lp, k + 1 FROM ch JOIN zn ON zn.setting = ch.setting AND zn.h = ch.h JOIN kn ON kn.setting = ch.setting AND kn.h = ch.h AND kn.lo <= floor({u} * zn.size) AND floor({u} * zn.size) < kn.hi LEFT JOIN zn nx ON nx.setting = kn.setting AND nx.h = kn.t WHERE k < {steps})"""


#: Words of a document that generation goes on from, and tokens that it adds.
PROMPT, ADDED = 32, 12
REGENERATED = [Setting(f"t{c['temperature']}-p{c['top_p']}", c["temperature"], c["top_p"]) for c in attacks.regenerations([0.2, 0.8, 1.2, 1.20001], [0.5, 0.95])]


@query("regen", f"""WITH RECURSIVE {_tokens('cd', 'documents')}, {_MODEL}, {_nucleus(REGENERATED)}, pm AS (SELECT doc_id, list_transform(w[1:{PROMPT}], lambda x: lower(x)) AS w FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
{_chains("SELECT doc_id, 0 AS way, setting, coalesce(w[len(w)], '<s>') AS h FROM pm, sg", ADDED, "CAST(doc_id AS VARCHAR)")}
SELECT doc_id, temperature, top_p, array_to_string(w, ' ') || CASE WHEN len(w) > 0 THEN ' ' ELSE '' END || made AS text, round(lp, 6) AS lp FROM ch JOIN pm USING (doc_id) JOIN sg USING (setting) WHERE k = {ADDED}""")
def regen(spark, d):
    """Every document's first words, gone on from under every setting of a sweep over temperature and top-p."""
    rows = docs(spark, d).select("doc_id", "text")
    model = fitted(spark, lm.token_table(rows, "doc_id"))
    table = generation.guide(model, REGENERATED, written(spark, "guide"))
    words = F.transform(F.slice(text.split_words(F.coalesce("text", F.lit(""))), 1, PROMPT), F.lower)
    prompts = rows.select("doc_id", words.alias("w"))
    # Prompts meet their chains at the end, and do not go along through the steps.
    setting = F.explode(F.array(*[F.lit(s.name) for s in REGENERATED])).alias("setting")
    chains = prompts.select("doc_id", F.coalesce(F.get("w", F.size("w") - 1), F.lit(lm.START)).alias("h"), setting)
    made = generation.generate(chains, table, ADDED, "doc_id").join(prompts.select("doc_id", F.array_join("w", " ").alias("prompt")), "doc_id")
    told = F.create_map(*[x for s in REGENERATED for x in (F.lit(s.name), F.struct(F.lit(float(s.temperature)).alias("temperature"), F.lit(float(s.top_p)).alias("top_p")))])
    made = made.withColumn("s", told[F.col("setting")])
    return made.select("doc_id", "s.temperature", "s.top_p", F.concat_ws(" ", F.nullif("prompt", F.lit("")), "made").alias("text"), F.round("lp", 6).alias("lp"))


_DNA = f"""hf AS (SELECT doc_id, n // 2 AS half, avg(lp) AS own, sum(CASE WHEN pos < n // 2 THEN lp END) AS kept, max(CASE WHEN pos = n // 2 - 1 THEN t END) AS h FROM (SELECT doc_id, pos, cd.t, lp, count(*) OVER (PARTITION BY doc_id) AS n FROM cd JOIN st USING (doc_id, pos)) WHERE n >= 20 GROUP BY doc_id, n)"""
query("detector_dnagpt", f"""WITH RECURSIVE {_LM}, {_DNA}, {_nucleus([detectors.SAMPLED_AS])}, {_chains(f"SELECT doc_id, way, setting, h FROM hf, sg, range({REGENERATIONS}) w(way)", CONTINUED, "CAST(doc_id AS VARCHAR) || '-' || CAST(way AS VARCHAR)")}
SELECT doc_id, round(any_value(own) - avg((kept + lp) / (half + {CONTINUED})), 6) AS dnagpt FROM hf JOIN ch USING (doc_id) WHERE k = {CONTINUED} GROUP BY doc_id""")(_beside(lambda *a: detectors.dnagpt(*a, fitted=True)))


query("token_jsd", f"WITH c AS (SELECT raw, sum(1 - quality) AS a, sum(quality) AS b FROM (SELECT doc_id, lower(unnest({WORDS})) AS raw FROM documents) JOIN labels USING (doc_id) GROUP BY raw), p AS (SELECT a / (SELECT sum(a) FROM c) AS p, b / (SELECT sum(b) FROM c) AS r FROM c) SELECT round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + r)) ELSE 0 END + CASE WHEN r > 0 THEN r * ln(2 * r / (p + r)) ELSE 0 END) / 2, 6) AS jsd FROM p")(lambda s, d: lm.divergence(lm.token_table(docs(s, d), "doc_id").join(table(s, d, "labels"), "doc_id"), "t", "quality"))
query("trim_to_shorter", "WITH p AS (SELECT a.doc_id, string_split(a.text, ' ') AS x, string_split(b.text, ' ') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0) SELECT doc_id, array_to_string(x[1:least(len(x), len(y))], ' ') AS a, array_to_string(y[1:least(len(x), len(y))], ' ') AS b FROM p")(lambda s, d: _trim(docs(s, d)))


def _trim(df):
    a = df.where("doc_id % 2 = 0").select("doc_id", F.split("text", " ").alias("x"))
    b = df.where("doc_id % 2 = 1").select((F.col("doc_id") - 1).alias("doc_id"), F.split("text", " ").alias("y"))
    n = F.least(F.size("x"), F.size("y"))
    return a.join(b, "doc_id").select("doc_id", F.array_join(F.slice("x", 1, n), " ").alias("a"), F.array_join(F.slice("y", 1, n), " ").alias("b"))


# Neighbours
_KNN = "n AS (SELECT q.vec_id AS query, b.vec_id AS id, CAST(b.label >= 5 AS INT) AS y, CAST(q.label >= 5 AS INT) AS truth, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS place FROM embeddings q, embeddings b WHERE q.vec_id % 5 = 0 AND b.vec_id % 5 > 0)"


def knn(spark, d, k):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), (F.col("label") >= 5).cast("int").alias("y"))
    return neighbours.nearest(e.where("id % 5 = 0"), e.where("id % 5 > 0"), k, folder=written(spark, "neighbours"))


query("knn_vote", f"WITH {_KNN} SELECT query, CAST(2 * sum(y) >= count(*) AS INT) AS vote FROM n WHERE place <= 10 GROUP BY query")(lambda s, d: neighbours.votes(knn(s, d, 10)).select("query", "vote"))
query("knn_prob", f"WITH {_KNN} SELECT query, round(avg(y), 6) AS prob FROM n WHERE place <= 7 GROUP BY query")(lambda s, d: neighbours.votes(knn(s, d, 7)).select("query", "prob"))
query("knn_sweep", f"WITH {_KNN}, v AS (SELECT query, place AS k, truth, CAST(2 * sum(y) OVER (PARTITION BY query ORDER BY place) >= place AS INT) AS vote FROM n WHERE place <= 9) SELECT CAST(k AS INT) AS k, round(avg(CAST(vote = truth AS INT)), 6) AS acc, round((sum(CASE WHEN vote = 0 AND truth = 0 THEN 1 ELSE 0 END) / greatest(sum(1 - truth), 1) + sum(CASE WHEN vote = 1 AND truth = 1 THEN 1 ELSE 0 END) / greatest(sum(truth), 1)) / 2, 6) AS avg_rec FROM v GROUP BY k")(lambda s, d: neighbours.sweep(knn(s, d, 9), table(s, d, "embeddings").select(F.col("vec_id").alias("query"), (F.col("label") >= 5).cast("int").alias("truth")), 9))

# Graph
_NODES = rf"se AS (SELECT doc_id, i - 1 AS sentence, s[i] AS s FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, {SENT} AS s FROM documents))), en AS (SELECT doc_id, sentence, k - 1 AS place, e[k] AS entity FROM (SELECT doc_id, sentence, e, unnest(generate_series(1, len(e))) AS k FROM (SELECT doc_id, sentence, list_filter(regexp_extract_all(s, '\p{{L}}+'), lambda w: regexp_matches(w, '^[A-Z][a-z]+$')) AS e FROM se)))"
query("graph_inner_edges", f"WITH {_NODES} SELECT * FROM (SELECT doc_id, CAST(sentence AS INT) AS sentence, CAST(place AS INT) AS place, entity, lead(entity) OVER (PARTITION BY doc_id, sentence ORDER BY place) AS next FROM en) WHERE next IS NOT NULL")(lambda s, d: graph.inner_edges(graph.entities(docs(s, d), "doc_id"), "doc_id"))
query("graph_inter_edges", f"WITH {_NODES}, u AS (SELECT DISTINCT doc_id, sentence, entity FROM en) SELECT a.doc_id, a.entity, CAST(a.sentence AS INT) AS first, CAST(b.sentence AS INT) AS second FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.entity = b.entity AND a.sentence < b.sentence")(lambda s, d: graph.inter_edges(graph.entities(docs(s, d), "doc_id"), "doc_id"))

# Streams, in batch form
query("stream_drift", "SELECT CAST(time_bucket(INTERVAL 1 hour, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")(lambda s, d: monitors.drift(table(s, d, "events"), "ts", "value", "event_type"))
query("running_means", "SELECT round(avg(value), 6) AS mean_value, count(value) AS n_value FROM events WHERE NOT isnan(value)")(lambda s, d: monitors.running_means(table(s, d, "events"), "value"))
query("log_replay", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")(lambda s, d: monitors.replay(table(s, d, "events").select("event_id", "user_id"), "user_id", "event_id", 5))
query("job_expiry", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 hours")(lambda s, d: monitors.unexpired(table(s, d, "events").crossJoin(F.broadcast(table(s, d, "events").agg(F.max("ts").alias("now")))), "ts", F.col("now")).select("event_id"))

# Python only where no built-in has the measure
@cache
def fuzzy():
    @F.pandas_udf("ratio double, token_set double")
    def both(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(round(fuzz.ratio(x, y), 6), round(fuzz.token_set_ratio(x, y), 6)) for x, y in zip(a, b, strict=True)], columns=["ratio", "token_set"])

    return both


@query("fuzz_ratio")
def fuzz_ratio(spark, d):
    """Both ratios of every document with each of its rewrites."""
    rows = detectors.rewrites(docs(spark, d), "doc_id")
    each = rows.select("doc_id", "text", F.explode(F.array(*[F.struct(F.lit(r).alias("rewrite"), F.col(r).alias("t")) for r in detectors.REWRITES])).alias("r"))
    return each.select("doc_id", "r.rewrite", fuzzy()("text", "r.t").alias("f")).select("doc_id", "rewrite", "f.*")


_PRESETS = (("tpr@fpr<=0.01", "high", 1), ("tpr@fpr<=0.05", "mean", 1), ("acc", "mean", 2), ("f1", "low", 2), ("decision", "low", 3))


@query("threshold_presets", f"WITH {SCORED}, g AS (SELECT lang || '/' || source AS file, round(min(prob), 6) AS low, round(avg(prob), 6) AS mean, round(max(prob), 6) AS high FROM scored GROUP BY lang, source) " + " UNION ALL ".join(f"SELECT file, '{n}' AS preset, {c} AS threshold, {p} AS priority FROM g" for n, c, p in _PRESETS))
def threshold_presets(spark, d):
    """Thresholds from a calibrator's document for each language and source of the scored documents."""
    g = scored(spark, d).groupBy("lang", "source").agg(*[F.round(f("prob"), 6).alias(n) for n, f in (("low", F.min), ("mean", F.avg), ("high", F.max))])
    at = F.create_map(F.lit("0.01"), F.struct(F.col("high").alias("threshold")), F.lit("0.05"), F.struct(F.col("mean").alias("threshold")))
    decision = F.struct(F.struct(F.col("mean").alias("acc"), F.struct(F.col("low").alias("thr")).alias("f1")).alias("thresholds"), F.col("low").alias("threshold"))
    files = g.select(F.concat_ws("/", "lang", "source").alias("file"), F.to_json(F.struct(F.struct(F.struct(at.alias("tpr_at_fpr"), decision.alias("decision")).alias("dev")).alias("meta"))).alias("value"))
    return calibration.presets(files)


query("build_dataset")(lambda s, d: _built(s, d))


class _Continuer:
    """A stand-in for a generating model: each prompt and after it its words in hashed order."""

    def generate(self, prompts):
        order = lambda p: sorted(enumerate(p.split()), key=lambda x: hashlib.sha1(f"{rng.SEED}:{p}:gen:{x[0]}".encode()).digest())
        return [" ".join([p, *(w for _, w in order(p))]) for p in (p or "" for p in prompts)]


def _built(spark, d):
    """Every document and a machine text for it, in split pairs."""
    from .api import build

    return build(docs(spark, d).select(F.col("doc_id").alias("id"), "text", "lang"), _Continuer)


@query("pu_prior_by_length")
def pu_prior_by_length(spark, d):
    """The prior of each document by its length in words, computed once for each length that occurs."""
    rows = docs(spark, d).select("doc_id", F.size(text.split_words(F.col("text"))).alias("n"))
    return rows.join(lm.length_priors(rows.select("n").distinct(), 0.2), "n").select("doc_id", "n", "prior")


def _dropped(seed: int) -> str:
    u = uniform_sql(f"'{seed}'", "CAST(doc_id AS VARCHAR)", "'drop'", "CAST(i - 1 AS VARCHAR)")
    return f"SELECT doc_id, {seed + 1} AS variant, CASE WHEN len(w) > 5 AND len(k) >= 5 AND array_to_string(k, ' ') <> text THEN array_to_string(k, ' ') ELSE text END AS text FROM (SELECT doc_id, text, w, list_transform(list_filter(list_transform(w, lambda x, i: {{'x': x, 'u': {u}}}), lambda s: s.u >= 0.1), lambda s: s.x) AS k FROM (SELECT doc_id, text, {WORDS} AS w FROM documents))"


_BAGS = f"SELECT doc_id, t, sum(x) AS x, sum(y) AS y FROM (SELECT doc_id, lower(unnest({WORDS})) AS t, 1 AS x, 0 AS y FROM documents UNION ALL SELECT doc_id, lower(unnest({WORDS})), 0, 1 FROM ({_dropped(0)})) GROUP BY doc_id, t"
_LIKE = f"SELECT doc_id, round(CASE WHEN sum(y) > 0 THEN sum(least(x, y)) / sum(y) ELSE 0 END, 6) AS precision, round(CASE WHEN sum(x) > 0 THEN sum(least(x, y)) / sum(x) ELSE 0 END, 6) AS recall, round(2 * sum(least(x, y)) / sum(x + y), 6) AS f1, round(CASE WHEN sum(x) * sum(y) > 0 THEN sum(x * y) / sqrt(CAST(sum(x * x) AS DOUBLE) * sum(y * y)) ELSE 0 END, 6) AS cosine FROM ({_BAGS}) GROUP BY doc_id"


@query("text_quality", f"WITH {_LM}, rd AS ({ORACLES['readability']}), pp AS (SELECT doc_id, round(exp(-sum(lp) / count(*)), 6) AS perplexity FROM st GROUP BY doc_id), li AS ({_LIKE}) SELECT * FROM rd LEFT JOIN pp USING (doc_id) LEFT JOIN li USING (doc_id)")
def text_quality(spark, d):
    """Readability, perplexity, and likeness to a text made from it (here without some words); what a text has no value of is null."""
    rows = docs(spark, d)
    read = rows.select("doc_id", text.readability(F.col("text"), latin_only=True).alias("r")).select("doc_id", "r.*")
    made = rows.select("doc_id", "text", F.coalesce(attacks.word_drop(F.col("text"), F.col("doc_id").cast("string"), 0.1, seed=0), F.col("text")).alias("made"))
    perplexity = lm.strided_perplexity(statistics(spark, d, "lp"), "doc_id").select("doc_id", "perplexity")
    return read.join(perplexity, "doc_id", "left").join(similarity.shared_tokens(made, "doc_id", "text", "made"), "doc_id", "left")


@query("classifier_heldout")
def classifier_heldout(spark, d):
    """Probabilities of quality for the labelled documents that the classifier was not trained on."""
    rows = sampling.split(docs(spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"), "doc_id")
    model = classifier.fit(rows.where("split = 'train'"), folder=written(spark, "classifier"))
    return model.score(rows.where("split <> 'train'")).select("doc_id", "split", "label", F.round(calibration.sigmoid(F.col("score")), 3).alias("prob"))


class _Shuffler:
    """A stand-in for a paraphrasing model: each text with its sentences in reverse."""

    def generate(self, prompts):
        return [" ".join(p.split(". ")[::-1]) for p in prompts]


@query("attack_paraphrase", "SELECT doc_id, attacked FROM (SELECT doc_id, text, array_to_string(list_reverse(string_split(text, '. ')), ' ') AS attacked FROM documents) WHERE attacked <> text")
def attack_paraphrase(spark, d):
    from .api import generated

    return generated(docs(spark, d).select("doc_id", F.col("text").alias("prompt")), _Shuffler, to="attacked").where("attacked <> prompt").select("doc_id", "attacked")
