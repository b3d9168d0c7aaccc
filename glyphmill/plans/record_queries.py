"""Queries for sources, record shapes, alignment and attack success."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import normalize as norm
from ..functions import rng
from ..operators import alignment, sampling
from ..sources import readers, sinks
from .base import SCORED, query, scored, table, uniform_sql, written
from .text_queries import STRIP, docs


def flat(spark, d):
    """documents as flat example records."""
    return docs(spark, d).select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 3 == 0, "human").when(F.col("doc_id") % 3 == 1, "gpt").otherwise("?").alias("label"), "lang", "source")


_FLAT = "SELECT CAST(doc_id AS VARCHAR) AS id, " + STRIP.format("text") + " AS text, CAST(CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS INT) AS label, lang, source, CAST(NULL AS VARCHAR) AS model FROM documents WHERE doc_id % 3 < 2 AND " + STRIP.format("text") + " <> ''"


@query("scan_jsonl", _FLAT)
def scan_jsonl(spark, d):
    path = written(spark, "jsonl")
    sinks.write_jsonl(flat(spark, d), path)
    return readers.examples(readers.scan_jsonl(spark, path))


@query("scan_json", "SELECT CAST(item_id AS VARCHAR) AS id, text, CAST(item_id % 2 AS INT) AS label FROM benchmark")
def scan_json(spark, d):
    """A file for each hash of the ids, each with a list of a bounded share of the items."""
    path = written(spark, "json")
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", (F.col("item_id") % 2).alias("label"))
    files = max(1, rows.count() // 1000)
    lists = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(files)).alias("file")).agg(F.to_json(F.struct(F.collect_list(F.struct("id", "text", "label")).alias("examples"))).alias("value"))
    lists.write.partitionBy("file").text(path)
    return readers.examples(readers.scan_json(spark, f"{path}/*/*")).select("id", "text", "label")


@query("scan_csv", "SELECT CAST(item_id AS VARCHAR) AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CAST(item_id % 2 AS INT) AS label, 'bench' AS source FROM benchmark")
def scan_csv(spark, d):
    path = written(spark, "csv")
    table(spark, d, "benchmark").select(F.col("item_id").alias("ID"), F.col("text").alias("Answer"), (F.col("item_id") % 2).alias("Label"), F.lit("bench").alias("SRC")).write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.scan_csv(spark, path)


query("scan_union", "SELECT CAST(doc_id AS VARCHAR) AS id, lang, CAST(NULL AS VARCHAR) AS url FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), NULL, url FROM pages")(lambda s, d: readers.union(docs(s, d).select(F.col("doc_id").cast("string").alias("id"), "lang"), table(s, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), "url")))


def answers(spark, d):
    """conversations as question records with the users' turns as human and the assistants' as machine answers."""
    c = table(spark, d, "conversations")
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    return c.groupBy("conv_id").agg(of("user").alias("human_answers"), of("assistant").alias("chatgpt_answers"))


_ANSWERS = "a AS (SELECT conv_id, " + STRIP.format("text") + " AS text, CASE role WHEN 'user' THEN 0 ELSE 1 END AS label, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place FROM conversations WHERE role IN ('user', 'assistant'))"
query("hc3_flatten_all", f"WITH {_ANSWERS} SELECT conv_id, text, CAST(label AS INT) AS label, CAST(place AS INT) AS place FROM a WHERE text <> ''")(lambda s, d: readers.flatten_answers(answers(s, d), "conv_id", "human_answers", "chatgpt_answers"))
_BAL = f"WITH {_ANSWERS}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, label ORDER BY sha1('114514:' || CAST(conv_id AS VARCHAR) || ':' || CAST(label AS VARCHAR) || ':' || CAST(place AS VARCHAR))) AS n, least(sum(1 - label) OVER (PARTITION BY conv_id), sum(label) OVER (PARTITION BY conv_id)) AS size FROM a WHERE text <> '') SELECT conv_id, text, CAST(label AS INT) AS label, CAST(place AS INT) AS place FROM r WHERE n <= "
query("hc3_balance_min", _BAL + "size")(lambda s, d: readers.balanced_answers(readers.flatten_answers(answers(s, d), "conv_id", "human_answers", "chatgpt_answers"), "conv_id"))
query("hc3_one_each", _BAL + "least(1, size)")(lambda s, d: readers.balanced_answers(readers.flatten_answers(answers(s, d), "conv_id", "human_answers", "chatgpt_answers"), "conv_id", one_each=True))
query("hc3_sample_record", f"WITH {_ANSWERS}, k AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY sha1('114514:' || CAST(conv_id AS VARCHAR)), conv_id LIMIT 30) SELECT conv_id, text, CAST(label AS INT) AS label, CAST(place AS INT) AS place FROM a JOIN k USING (conv_id) WHERE text <> ''")(lambda s, d: readers.flatten_answers(sampling.exact(answers(s, d), "conv_id", 30), "conv_id", "human_answers", "chatgpt_answers"))
query("flatten_pairs", "SELECT doc_id AS id, text, CAST(label AS INT) AS label, split FROM (SELECT doc_id, " + STRIP.format("text") + " AS text, 0 AS label, 'original' AS split FROM documents UNION ALL SELECT doc_id, lang || ' ' || source, 1, 'sampled' FROM documents UNION ALL SELECT doc_id, 'r ' || lang, 1, 'rewritten' FROM documents WHERE doc_id % 2 = 0) WHERE text <> ''")(lambda s, d: readers.flatten_lists(docs(s, d).select(F.col("doc_id").alias("id"), F.array("text").alias("original"), F.array(F.concat_ws(" ", "lang", "source"), F.lit(" ")).alias("sampled"), F.when(F.col("doc_id") % 2 == 0, F.array(F.concat(F.lit("r "), "lang"))).alias("rewritten"))))


def paired(spark, d):
    """documents as paired records: a source sample, and one or two attacked ones for two ids in three."""
    sample = lambda name, t: F.struct(F.lit(name).alias("attack"), t.alias("text"))
    base, typo, para = sample("src", F.col("text")), sample("text_typo", F.concat(F.lit("t "), F.substring("text", 1, 30))), sample("text_para", F.concat(F.lit("p "), F.substring("text", 1, 30)))
    return docs(spark, d).select(F.col("doc_id").alias("id"), "lang", F.when(F.col("doc_id") % 3 == 0, F.array(base)).when(F.col("doc_id") % 3 == 1, F.array(base, typo)).otherwise(F.array(base, typo, para)).alias("sample"))


_S = "s AS (SELECT doc_id AS id, lang, 1 AS k, 'src' AS attack, text FROM documents UNION ALL SELECT doc_id, lang, 2, 'text_typo', 't ' || substr(text, 1, 30) FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id, lang, 3, 'text_para', 'p ' || substr(text, 1, 30) FROM documents WHERE doc_id % 3 = 2)"
query("flatten_attack_only", f"WITH {_S} SELECT id, lang, attack, substr(attack, 1, 12) AS attack_short, text FROM s WHERE k > 1 OR id % 3 = 0")(lambda s, d: readers.attack_samples(paired(s, d)))
query("attack_groups_paired", f"WITH {_S} SELECT id, attack, text FROM s WHERE k > 1 AND id IN (SELECT doc_id FROM labels WHERE quality = 1)")(lambda s, d: readers.attack_samples(paired(s, d).where("size(sample) > 1")).join(table(s, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "attack", "text"))
query("builder_view_pre", f"WITH {_S} SELECT id, attack, text FROM s WHERE k = 1")(lambda s, d: readers.builder_view(paired(s, d), post=False))
query("builder_view_post", f"WITH {_S} SELECT id, attack, text FROM s WHERE k > 1 QUALIFY k = max(k) OVER (PARTITION BY id)")(lambda s, d: readers.builder_view(paired(s, d), post=True))
query("paired_base_dedup", "SELECT id, doc_id AS seq, lang FROM (SELECT doc_id % 100 AS id, doc_id, lang FROM documents) QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1")(lambda s, d: sampling.first_of(docs(s, d).select((F.col("doc_id") % 100).alias("id"), F.col("doc_id").alias("seq"), "lang"), ["id"], "seq"))
query("flat_base", "SELECT doc_id AS id, " + STRIP.format("coalesce(CASE WHEN doc_id % 2 = 0 THEN text END, lang || source)") + " AS text FROM documents")(lambda s, d: docs(s, d).select(F.col("doc_id").alias("id"), norm.text_of(F.when(F.col("doc_id") % 2 == 0, F.col("text")), F.lit(" "), F.concat("lang", "source")).alias("text")).where("text IS NOT NULL"))
query("attack_groups_flat", "SELECT id, attack, text FROM (SELECT doc_id AS id, 'text_typo' AS attack, upper(lang) AS text FROM documents UNION ALL SELECT doc_id, 'text_para', CASE WHEN doc_id % 2 = 0 THEN source END FROM documents) WHERE text IS NOT NULL")(lambda s, d: readers.unpivot_attacks(docs(s, d).select(F.col("doc_id").alias("id"), F.col("text").alias("text_src"), F.upper("lang").alias("text_typo"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("text_para")), "id"))
query("load_official_keys", "SELECT text, coalesce(g, 'human') AS generator, CAST(CASE WHEN g IS NULL THEN 1 - item_id % 2 WHEN lower(g) = 'human' THEN 0 ELSE 1 END AS INT) AS label FROM (SELECT text, item_id, CASE WHEN item_id % 3 = 0 THEN 'gpt-j' WHEN item_id % 3 = 1 THEN 'Human' END AS g FROM benchmark)")(lambda s, d: readers.official_keys(table(s, d, "benchmark").select(F.parse_json(F.to_json(F.struct("text", F.when(F.col("item_id") % 3 == 0, "gpt-j").when(F.col("item_id") % 3 == 1, "Human").alias("src"), (F.col("item_id") % 2).alias("label")))).alias("record"))))


@query("load_unified", _FLAT + f" UNION ALL SELECT * FROM (WITH {_ANSWERS} SELECT CAST(conv_id AS VARCHAR), text, CAST(label AS INT), NULL, NULL, NULL FROM a WHERE text <> '')")
def load_unified(spark, d):
    flat_part = readers.examples(flat(spark, d).select(F.parse_json(F.to_json(F.struct("*"))).alias("record")))
    qa = readers.flatten_answers(answers(spark, d), "conv_id", "human_answers", "chatgpt_answers")
    return readers.union(flat_part, qa.select(F.col("conv_id").cast("string").alias("id"), "text", "label"))


query("humanize_pool", "SELECT label, text, min(doc_id) AS first FROM (SELECT d.doc_id, 1 - quality AS label, " + STRIP.format("text") + " AS text FROM documents d JOIN labels USING (doc_id)) WHERE text <> '' GROUP BY label, text")(lambda s, d: sampling.first_of(docs(s, d).join(table(s, d, "labels"), "doc_id").select((1 - F.col("quality")).alias("label"), norm.text_of(F.col("text")).alias("text"), F.col("doc_id").alias("first")).where("text IS NOT NULL"), ["label", "text"], "first").select("label", "text", "first"))

# Alignment and attack success: bases are scored documents, variants their deterministic perturbations
_V = uniform_sql("'v'", "method", "CAST(id AS VARCHAR)", "CAST(c AS VARCHAR)")
_VARIANTS = f"v AS (SELECT id AS k, method, y, c, {_V} AS prob, id * 10 + c AS seq FROM scored, (SELECT unnest(['typo', 'para', 'tran']) AS method), (SELECT unnest([1, 2]) AS c) WHERE id % 5 > 0 AND (method <> 'tran' OR id % 2 = 0)), ok AS (SELECT id AS k FROM scored WHERE (prob >= 0.5) = (y = 1))"


def bases(spark, d):
    return scored(spark, d).select(F.col("id").alias("k"), "y", "prob")


def variants(spark, d):
    rows = scored(spark, d).where("id % 5 > 0").select(F.col("id").alias("k"), "y", F.explode(F.array(*map(F.lit, ("typo", "para", "tran")))).alias("method")).where("method <> 'tran' OR k % 2 = 0")
    rows = rows.withColumn("c", F.explode(F.array(F.lit(1), F.lit(2))))
    return rows.select("k", "method", "y", "c", rng.uniform("v", F.col("method"), F.col("k"), F.col("c")).alias("prob"), (F.col("k") * 10 + F.col("c")).alias("seq"))


_ASR = "count(*) AS attack_eval_n, CAST(sum(n) AS BIGINT) AS attack_variant_n, round(sum(r) / sum(n), 6) AS variant_acc, round(1 - avg(fell), 6) AS attack_acc, round(avg(fell), 6) AS asr, (SELECT count(*) FROM ok) AS base_correct_n"
_PER = "SELECT {0}, count(*) AS n, sum(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS r, max(CASE WHEN (prob >= 0.5) = (y = 1) THEN 0 ELSE 1 END) AS fell FROM v WHERE k IN (SELECT k FROM ok) GROUP BY {0}"
_BY_METHOD = f"SELECT method, {_ASR} FROM ({_PER.format('method, k')}) GROUP BY method"
_W = f"WITH {SCORED}, {_VARIANTS} "
query("asr_by_method", _W + _BY_METHOD)(lambda s, d: alignment.attack_success(bases(s, d), variants(s, d)))
query("asr_paired_pooled", _W + f"SELECT {_ASR} FROM ({_PER.format('k')})")(lambda s, d: alignment.attack_success(bases(s, d), variants(s, d), by_method=False))
query("asr_any_success", _W + f"SELECT {_ASR} FROM ({_PER.format('k').replace('WHERE k', 'WHERE method = ' + chr(39) + 'typo' + chr(39) + ' AND k')})")(lambda s, d: alignment.attack_success(bases(s, d), variants(s, d).where("method = 'typo'"), by_method=False))
query("asr_pairwise", _W + "SELECT count(*) AS n, round(avg(r), 6) AS attack_acc, round(1 - avg(r), 6) AS asr FROM (SELECT CASE WHEN (prob >= 0.5) = (y = 1) THEN 1 ELSE 0 END AS r FROM v WHERE method = 'para' AND k IN (SELECT k FROM ok) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1)")(lambda s, d: alignment.pairwise_success(bases(s, d), variants(s, d).where("method = 'para'")))
query("asr_summary", _W + f"SELECT count(*) AS methods, round(avg(asr), 6) AS asr_mean, round(sum(asr * attack_eval_n) / sum(attack_eval_n), 6) AS asr_weighted FROM ({_BY_METHOD})")(lambda s, d: alignment.success_summary(alignment.attack_success(bases(s, d), variants(s, d))))
query("align_pairs_id", _W + "SELECT k, round(s.prob, 6) AS base_prob, round(v.prob, 6) AS attack_prob FROM (SELECT id AS k, prob FROM scored) s JOIN (SELECT k, prob FROM v WHERE method = 'typo' QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq) = 1) v USING (k)")(lambda s, d: alignment.pairs_by_id(bases(s, d).select("k", F.round("prob", 6).alias("base_prob")), variants(s, d).where("method = 'typo'").select("k", "seq", F.round("prob", 6).alias("attack_prob"))).select("k", "base_prob", "attack_prob"))
query("align_pairs_order", _W + "SELECT a.k AS base, b.k AS attack, CAST(n AS BIGINT) AS n FROM (SELECT id AS k, row_number() OVER (ORDER BY id) AS n FROM scored) a JOIN (SELECT k, row_number() OVER (ORDER BY seq) AS n FROM v WHERE method = 'typo') b USING (n)")(lambda s, d: alignment.pairs_by_order(bases(s, d).select(F.col("k").alias("base"), F.col("k").alias("seq")), variants(s, d).where("method = 'typo'").select(F.col("k").alias("attack"), "seq")))
query("align_one_to_many", _W + "SELECT count(*) AS bases, CAST(sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, count(n) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS variants, round(avg(n), 6) AS per_base FROM (SELECT DISTINCT id AS k FROM scored) LEFT JOIN (SELECT k, count(*) AS n FROM v GROUP BY k) USING (k)")(lambda s, d: alignment.one_to_many(bases(s, d), variants(s, d)))
query("base_correct_cache", _W + "SELECT DISTINCT v.k, coalesce(ok.k IS NOT NULL, false) AS ok FROM v LEFT JOIN ok ON v.k = ok.k")(lambda s, d: variants(s, d).select("k").distinct().join(alignment.base_correct(bases(s, d)), "k", "left").select("k", F.coalesce("ok", F.lit(False)).alias("ok")))
query("variants_of_correct", _W + "SELECT k, method, c FROM v WHERE k IN (SELECT k FROM ok)")(lambda s, d: alignment.variants_of_correct(bases(s, d), variants(s, d)).select("k", "method", "c"))
_CLASSES = "b AS (SELECT CASE WHEN trim(source) <> '' THEN 'source:' || source WHEN trim(lang) <> '' THEN 'lang:' || lang END AS bucket, quality AS y, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1)), r AS (SELECT *, row_number() OVER (PARTITION BY bucket, y ORDER BY sha1('114514:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM b)"
query("pair_by_keys", f"WITH {_CLASSES} SELECT h.bucket, CAST(h.n AS INT) AS n, h.doc_id AS human, m.doc_id AS machine FROM r h JOIN r m ON h.bucket IS NOT DISTINCT FROM m.bucket AND h.n = m.n AND h.y = 0 AND m.y = 1")(lambda s, d: alignment.paired_by_keys(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "quality", "doc_id"))
query("pair_human_machine", "WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY sha1('114514:' || CAST(turn AS VARCHAR)), turn) AS n FROM conversations) SELECT a.conv_id, CAST(a.n AS INT) AS n, a.turn AS human, b.turn AS machine FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.n = b.n AND a.role = 'user' AND b.role = 'assistant'")(lambda s, d: alignment.paired_classes(table(s, d, "conversations").withColumn("y", norm.role_label(F.col("role"))), "conv_id", "y", "turn"))
query("human_machine_link", "SELECT h.doc_id AS human, m.doc_id AS machine FROM documents h JOIN documents m ON m.doc_id = h.doc_id + 1 WHERE h.doc_id % 2 = 0")(lambda s, d: docs(s, d).where("doc_id % 2 = 0").select(F.concat(F.col("doc_id"), F.lit("-human")).alias("human_id"), F.col("doc_id").alias("human")).join(docs(s, d).where("doc_id % 2 = 1").select(F.concat(F.col("doc_id") - 1, F.lit("-human")).alias("human_id"), F.col("doc_id").alias("machine")), "human_id").select("human", "machine"))
query("quality_means", "SELECT measure, count(*) AS n, round(avg(d), 6) AS mean FROM (SELECT 'chars' AS measure, CAST(length(substr(text, 1, 100)) - length(text) AS DOUBLE) AS d FROM documents UNION ALL SELECT 'words', CAST(CASE WHEN doc_id % 4 > 0 THEN length(substr(text, 1, 100)) - length(replace(substr(text, 1, 100), ' ', '')) - length(text) + length(replace(text, ' ', '')) END AS DOUBLE) FROM documents) WHERE d IS NOT NULL GROUP BY measure")(lambda s, d: _quality(docs(s, d)))


def _quality(df):
    cut = F.substring("text", 1, 100)
    spaces = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("double")
    rows = df.select(F.length("text").cast("double").alias("orig_chars"), F.length(cut).cast("double").alias("chars"), F.when(F.col("doc_id") % 4 > 0, spaces(F.col("text"))).alias("orig_words"), spaces(cut).alias("words"))
    return alignment.quality_means(rows, "orig", ["chars", "words"])


