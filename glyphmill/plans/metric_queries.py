"""Queries for metrics, curves and calibration over the scored documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rng
from ..operators import calibration as cal
from ..operators import bootstrap, curves, metrics
from .base import RATES, SCORED, counts, query, scored, table

C = counts()
GROUP = f"n, tp, fp, tn, fn, {RATES}"


def _with(sql: str, *more: str) -> str:
    return f"WITH {', '.join([SCORED, *more])} {sql}"


query("basic_stats", _with(f"SELECT n, prob_mean, prob_min, prob_max, tp, fp, tn, fn, {RATES} FROM (SELECT count(*) AS n, round(avg(prob), 6) AS prob_mean, round(min(prob), 6) AS prob_min, round(max(prob), 6) AS prob_max, {C} FROM scored)"))(lambda s, d: metrics.basic_stats(scored(s, d)))
query("threshold_metrics", _with(f"SELECT CAST(0.7 AS DOUBLE) AS threshold, tp, fp, tn, fn, {RATES} FROM (SELECT {counts('0.7')} FROM scored)"))(lambda s, d: metrics.threshold_table(scored(s, d), [0.7]))
query("threshold_table", _with(f"SELECT threshold, tp, fp, tn, fn, {RATES} FROM (SELECT threshold, {counts('threshold')} FROM scored, (SELECT CAST(unnest([0.5, 0.62, 0.8]) AS DOUBLE) AS threshold) GROUP BY threshold)"))(lambda s, d: metrics.threshold_table(scored(s, d), [0.5, 0.62, 0.62 + 1e-12, 0.8]))
query("by_group", _with(f"SELECT value, {GROUP} FROM (SELECT lang AS value, count(*) AS n, {C} FROM scored WHERE trim(lang) <> '' AND lower(trim(lang)) NOT IN ('de') GROUP BY lang)"))(lambda s, d: metrics.by_group(scored(s, d), "lang", exclude=("DE",)))
for _name, _column in (("per_lang", "lang"), ("per_domain", "source"), ("per_model", "model")):
    query(_name, _with(f"SELECT value, {GROUP} FROM (SELECT {_column} AS value, count(*) AS n, {C} FROM scored WHERE trim({_column}) <> '' GROUP BY {_column})"))(lambda s, d, c=_column: metrics.by_group(scored(s, d), c))
query("per_model_machines", _with(f"SELECT value, {GROUP} FROM (SELECT model AS value, count(*) AS n, {C} FROM scored WHERE y = 1 AND lower(model) <> 'human' GROUP BY model)"))(lambda s, d: metrics.by_group(scored(s, d), "model", exclude=("human",), include=F.col("y") == 1))
query("group_all_grouping_sets", _with(" UNION ALL ".join(f"SELECT '{c}' AS dimension, value, {GROUP} FROM (SELECT {c} AS value, count(*) AS n, {C} FROM scored GROUP BY {c})" for c in ("lang", "source", "model"))))(lambda s, d: metrics.all_groups(scored(s, d), ["lang", "source", "model"]))
query("class_recalls", _with(f"SELECT tp, fp, tn, fn, human_rec, machine_rec, round((human_rec + machine_rec) / 2, 6) AS avg_rec, {RATES} FROM (SELECT *, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END, 6) AS human_rec, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS machine_rec FROM (SELECT {C} FROM scored))"))(lambda s, d: metrics.class_recalls(scored(s, d)))
_BIN = "least(9, CAST(floor(prob * 10) AS INT))"
query("reliability_bins", _with(f"SELECT CAST(r.bin AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(conf, 0), 6) AS conf, round(coalesce(acc, 0), 6) AS acc, round(coalesce(abs(acc - conf), 0), 6) AS gap FROM range(10) r(bin) LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n, avg(prob) AS conf, avg(y) AS acc FROM scored GROUP BY 1) b ON r.bin = b.bin"))(lambda s, d: metrics.reliability_bins(scored(s, d)))
query("ece_brier", _with(f"SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(abs(p - y)) / sum(n), 6) AS ece, round(sum(sq) / sum(n), 6) AS brier FROM (SELECT {_BIN} AS bin, count(*) AS n, sum(prob) AS p, sum(y) AS y, sum((prob - y) * (prob - y)) AS sq FROM scored GROUP BY 1)"))(lambda s, d: metrics.ece_brier(scored(s, d)))

# Cells of (score, label); a cell's weight in a replicate is a sum of Poisson draws for the powers of two of its rows, from digests cut in five.
_BITS = 7
_TABLES = " ".join(f"WHEN {b} THEN [" + ", ".join(f"CAST('{x!r}' AS DOUBLE)" for x in bootstrap.poisson_table(b).tolist()) + "]" for b in range(_BITS))
_BOOT = f"""ce AS (SELECT prob, y, count(*) AS n, min(id) AS k FROM scored GROUP BY prob, y),
dg AS (SELECT prob, y, k, bit, block, sha1(concat_ws(':', '114514', CAST(block AS VARCHAR), CAST(k AS VARCHAR), CAST(bit AS VARCHAR))) AS h FROM ce, range({_BITS}) b(bit), range({bootstrap.ITERATIONS // 5}) r(block) WHERE n >> bit & 1 = 1),
dr AS (SELECT prob, y, k, bit, block * 5 + piece AS r, CAST('0x' || substr(h, CAST(1 + 8 * piece AS INT), 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS u FROM dg, range(5) p(piece)),
wt AS (SELECT r, prob, y, k, sum(len(list_filter(CASE bit {_TABLES} END, lambda t: t <= u))) AS w FROM dr GROUP BY ALL),
co AS (SELECT r, sum(CASE WHEN prob >= 0.5 AND y = 1 THEN w ELSE 0 END) AS tp, sum(CASE WHEN prob >= 0.5 AND y = 0 THEN w ELSE 0 END) AS fp, sum(CASE WHEN prob < 0.5 AND y = 0 THEN w ELSE 0 END) AS tn, sum(CASE WHEN prob < 0.5 AND y = 1 THEN w ELSE 0 END) AS fn FROM wt GROUP BY r),
ro AS (SELECT r, sum(neg * (above + pos / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, coalesce(sum(pos) OVER (PARTITION BY r ORDER BY prob DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM (SELECT r, prob, CAST(sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS DOUBLE) AS pos, CAST(sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS DOUBLE) AS neg FROM wt GROUP BY r, prob)) GROUP BY r),
pe AS (SELECT r, sum(CASE WHEN y = 1 AND w > 0 THEN list_sum(list_transform(generate_series(1, CAST(w AS BIGINT)), lambda j: ((tp + j) / (n0 + j) + CASE WHEN n0 + j = 1 THEN 1 ELSE (tp + j - 1) / (n0 + j - 1) END) / 2)) ELSE 0 END) / nullif(sum(CASE WHEN y = 1 THEN w ELSE 0 END), 0) AS aupr FROM (SELECT *, coalesce(sum(CASE WHEN y = 1 THEN w ELSE 0 END) OVER o, 0) AS tp, coalesce(sum(w) OVER o, 0) AS n0 FROM wt WINDOW o AS (PARTITION BY r ORDER BY prob DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY r),
per AS (SELECT (tp + tn) / nullif(tp + fp + tn + fn, 0) AS acc, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, auroc, aupr FROM co JOIN ro USING (r) JOIN pe USING (r))"""
_AT = "round(list_sort(list({v}) FILTER ({v} IS NOT NULL))[CAST(round_even({q} * (count({v}) - 1), 0) AS INT) + 1], 6)"
query("bootstrap_ci", _with("SELECT " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, {_AT.format(v=v, q=0.025)} AS {v}_lo, {_AT.format(v=v, q=0.975)} AS {v}_hi" for v in ("acc", "f1", "auroc", "aupr")) + " FROM per", _BOOT))(lambda s, d: bootstrap.intervals(scored(s, d)))


@query("k_runs_stats", _with(f"SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) ELSE 0 END, 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM (SELECT unnest(['acc', 'f1']) AS metric, unnest([acc, f1]) AS value FROM (SELECT run, {RATES} FROM (SELECT id % 5 AS run, {C} FROM scored GROUP BY 1))) GROUP BY metric"))
def k_runs_stats(spark, d):
    per = metrics.with_rates(scored(spark, d).groupBy((F.col("id") % 5).alias("run")).agg(*[c.alias(n) for n, c in metrics.confusion().items()]))
    return metrics.runs(per, "run", ["acc", "f1"])


_POINTS = "o AS (SELECT *, sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp, sum(y) OVER () AS p, sum(1 - y) OVER () AS n FROM scored WINDOW w AS (ORDER BY prob DESC, id))"
_AUC = "SELECT round(avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END), 6) AS auc FROM scored a, scored b WHERE a.y = 1 AND b.y = 0"
query("roc_auc", _with(_AUC))(lambda s, d: curves.roc_auc(scored(s, d)))
query("roc_auc_rank", _with(_AUC))(lambda s, d: curves.roc_auc_ranks(scored(s, d)))
query("roc_curve", _with("SELECT id AS seq, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM o", _POINTS))(lambda s, d: curves.roc_curve(scored(s, d)))
query("pr_curve", _with("SELECT id AS seq, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM o", _POINTS))(lambda s, d: curves.pr_curve(scored(s, d)))
query("pr_auc", _with("SELECT round(sum((r - r0) * (q + q0) / 2), 6) AS auc FROM (SELECT tp / p AS r, tp / (tp + fp) AS q, coalesce(lag(tp / p) OVER w, 0) AS r0, coalesce(lag(tp / (tp + fp)) OVER w, 1) AS q0 FROM o WINDOW w AS (ORDER BY prob DESC, id))", _POINTS))(lambda s, d: curves.pr_auc(scored(s, d)))
_OP = "g AS (SELECT prob, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY prob), tot AS (SELECT sum(pos) AS p, sum(neg) AS n FROM g), op AS (SELECT threshold, tp, fp, n - fp AS tn, p - tp AS fn, tp / p AS tpr, fp / n AS fpr, (tp + n - fp) / (p + n) AS acc, CASE WHEN tp + fp + p > 0 THEN 2 * tp / (tp + fp + p) ELSE 0 END AS f1 FROM (SELECT prob AS threshold, CAST(sum(pos) OVER (ORDER BY prob DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY prob DESC) AS BIGINT) AS fp FROM g UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0), tot)"
query("tpr_at_fpr", _with("SELECT t.target, round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(acc, 6) AS acc, round(f1, 6) AS f1 FROM (SELECT CAST(unnest([0.0001, 0.001, 0.01, 0.05, 0.1]) AS DOUBLE) AS target) t JOIN op ON fpr <= t.target QUALIFY row_number() OVER (PARTITION BY t.target ORDER BY threshold) = 1", _OP))(lambda s, d: curves.tpr_at_fpr(scored(s, d)))
query("tpr_at_fpr_calib", _with("SELECT t.target, round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM (SELECT CAST(unnest([0.05, 0.01, 0.001, 0.0001]) AS DOUBLE) AS target) t JOIN op ON fpr <= t.target + 1e-12 QUALIFY row_number() OVER (PARTITION BY t.target ORDER BY tpr DESC, threshold DESC) = 1", _OP))(lambda s, d: curves.tpr_at_fpr_calibration(scored(s, d)))
query("tpr_at_fpr_simple", _with("SELECT round(max(tpr), 6) AS tpr FROM op WHERE fpr <= 0.01", _OP))(lambda s, d: curves.tpr_at_fpr_simple(scored(s, d)))
for _mode in ("acc", "f1", "tpr"):
    query(f"best_threshold_{_mode}", _with(f"SELECT round(threshold, 6) AS threshold, round(round({_mode}, 9), 6) AS value FROM op WHERE threshold < 'inf' ORDER BY round({_mode}, 9) DESC, threshold DESC LIMIT 1", _OP))(lambda s, d, m=_mode: curves.best_threshold(scored(s, d), m))
query("risk_coverage", _with("SELECT id AS seq, round(k / count(*) OVER (), 6) AS coverage, round(wrong / k, 6) AS risk FROM (SELECT id, row_number() OVER w AS k, sum(CASE WHEN (prob >= 0.5) <> (y = 1) THEN 1 ELSE 0 END) OVER w AS wrong FROM scored WINDOW w AS (ORDER BY round(greatest(prob, 1 - prob), 9) DESC, id))"))(lambda s, d: curves.risk_coverage(scored(s, d)))
query("moving_avg", "SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS average FROM events")(lambda s, d: curves.moving_average(table(s, d, "events").select("event_id", "user_id", "value"), "value", "event_id", 5, "user_id").select("event_id", "user_id", "average"))
query("score_moments", _with("SELECT count(prob) AS n, round(avg(prob), 6) AS mean, round(CASE WHEN stddev_pop(prob) < 1e-12 THEN 1 ELSE stddev_pop(prob) END, 6) AS std FROM scored"))(lambda s, d: metrics.moments(scored(s, d), "prob"))

# Calibration
query("platt_apply", _with("SELECT id, round(1 / (1 + exp(-greatest(least(-1.5 + 2.25 * (prob - 0.6) / 0.2, 80), -80))), 6) AS p FROM scored"))(lambda s, d: scored(s, d).select("id", F.round(cal.platt(F.col("prob"), cal.Platt(-1.5, 2.25, 0.6, 0.2)), 6).alias("p")))
query("linear_apply", _with("SELECT id, round(1 / (1 + exp(-(0.25 + 1.5 * (prob - 0.6) / 0.2 - 0.75 * (length(text) / CAST(1000 AS DOUBLE) - 2.0) / 3.0))), 6) AS p FROM scored"))(lambda s, d: scored(s, d).select("id", F.round(cal.linear(F.array(F.col("prob"), F.length("text") / 1000.0), cal.Linear([0.25, 1.5, -0.75], [0.6, 2.0], [0.2, 3.0])), 6).alias("p")))
query("sigmoid_fallback", _with("SELECT id, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-greatest(least(8 * prob, 80), -80))))), 6) AS p, round(greatest(1e-6, least(1 - 1e-6, 1 / (1 + exp(-greatest(least(-8 * prob, 80), -80))))), 6) AS inverted FROM scored"))(lambda s, d: scored(s, d).select("id", F.round(cal.fallback(F.col("prob")), 6).alias("p"), F.round(cal.fallback(F.col("prob"), invert=True), 6).alias("inverted")))
query("two_normal_prob", _with("SELECT id, round(b / (a + b), 6) AS p FROM (SELECT id, exp(-power((prob - 0.3) / 0.25, 2) / 2) / 0.25 AS a, exp(-power((prob - 0.8) / 0.2, 2) / 2) / 0.2 AS b FROM scored)"))(lambda s, d: scored(s, d).select("id", F.round(cal.two_normal(F.col("prob"), 0.3, 0.25, 0.8, 0.2), 6).alias("p")))
query("filter_nonfinite", _with("SELECT id, round(z, 6) AS z FROM (SELECT id, CASE id % 4 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN NULL ELSE prob END AS z FROM scored) WHERE z IS NOT NULL AND isfinite(z)"))(lambda s, d: cal.finite_rows(scored(s, d).select("id", F.when(F.col("id") % 4 == 0, float("nan")).when(F.col("id") % 4 == 1, float("inf")).when(F.col("id") % 4 == 2, None).otherwise(F.col("prob")).alias("z")), "z").select("id", F.round("z", 6).alias("z")))
query("platt_fit")(lambda s, d: cal.as_table(s, cal.fit_platt(scored(s, d), "prob", "y")))
query("linear_lr_fit")(lambda s, d: cal.as_table(s, cal.fit_linear(scored(s, d).withColumn("x", F.array(F.col("prob"), F.length("text") / 1000.0)), "x", "y")))
query("dataset_info", _with("SELECT y AS label, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM scored GROUP BY y"))(lambda s, d: scored(s, d).groupBy(F.col("y").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars")))
assert rng.SEED == 114514  # the SQL above states it
