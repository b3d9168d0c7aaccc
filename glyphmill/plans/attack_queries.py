"""Queries for perturbations."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import attacks as A
from .base import ORACLES, query, table, uniform_sql
from .text_queries import SENT, WORDS, docs

ID = "CAST(doc_id AS VARCHAR)"


def u(salt: str, i: str) -> str:
    return uniform_sql("'114514'", ID, f"'{salt}'", f"CAST({i} AS VARCHAR)")


def h(salt: str, i: str) -> str:
    return f"sha1('114514:' || {ID} || ':{salt}:' || CAST({i} AS VARCHAR))"


def attack(name: str, sql: str | None, make) -> None:
    """The changed texts. A generator leaves the others out, as a filter on the new column would compute it twice."""
    query(name, sql)(lambda s, d: docs(s, d).select("doc_id", F.explode(F.array_compact(F.array(make(F.col("text"), F.col("doc_id").cast("string"))))).alias("attacked")))


_W = f"w AS (SELECT doc_id, text, {WORDS} AS w FROM documents), e AS (SELECT doc_id, text, len(w) AS n, i - 1 AS i, w[i] AS x FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM w))"
_OUT = "SELECT doc_id, t AS attacked FROM ({0}) WHERE t <> text"
attack("attack_word_drop", f"WITH {_W} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(x, ' ' ORDER BY i) AS t FROM e WHERE n > 5 AND {u('drop', 'i')} >= 0.05 GROUP BY doc_id HAVING count(*) >= 5"), A.word_drop)
# Pairs to exchange are found in a string of flags, from left to right.
_SWAPPED = "list_transform(list_zip(w, string_split(f, ''), list_append(w[2:len(w)], NULL), list_prepend(NULL, w[1:len(w) - 1])), lambda s: CASE s[2] WHEN 'S' THEN s[3] WHEN 'X' THEN s[4] ELSE s[1] END)"
_FLAGS = "SELECT doc_id, any_value(text) AS text, list(x ORDER BY i) AS w, regexp_replace(string_agg(CASE WHEN {0} THEN '1' ELSE '0' END, '' ORDER BY i), '1[01]', 'SX', 'g') AS f FROM e WHERE {1} GROUP BY doc_id"
attack("attack_word_swap", f"WITH {_W} " + _OUT.format(f"SELECT doc_id, text, array_to_string({_SWAPPED}, ' ') AS t FROM ({_FLAGS.format('i + 1 < n AND ' + u('swap', 'i') + ' < 0.05', 'n >= 8')})"), A.word_swap)
_C = "e AS (SELECT doc_id, text, n, i - 1 AS i, c[i] AS x, c[i + 1] AS y FROM (SELECT doc_id, text, len(c) AS n, c, unnest(generate_series(1, len(c))) AS i FROM (SELECT doc_id, text, string_split(text, '') AS c FROM documents WHERE length(text) >= 30)))"
attack("attack_char_swap", f"WITH {_C} " + _OUT.format("SELECT doc_id, text, array_to_string(" + _SWAPPED + ", '') AS t FROM (" + _FLAGS.format("i + 1 < n AND " + u("chars", "i") + " < 0.01 AND regexp_matches(x, '^[\\p{L}\\p{N}]$') AND regexp_matches(y, '^[\\p{L}\\p{N}]$')", "true") + ")"), A.char_swap)
attack("attack_punct_noise", "WITH e AS (SELECT doc_id, text, i - 1 AS i, text[i] AS x FROM (SELECT *, unnest(generate_series(1, length(text))) AS i FROM documents WHERE length(text) >= 20)) " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN regexp_matches(x, '^[\\p{{L}}\\p{{N}}]$') AND {u('punct', 'i')} < 0.05 THEN x || substr(',.;:!?', CAST(floor({u('mark', 'i')} * 6) AS INT) + 1, 1) ELSE x END, '' ORDER BY i) AS t FROM e GROUP BY doc_id"), A.punct_noise)
_DICT = {"the": "a", "of": "from", "and": "plus", "de": "du", "der": "die"}
_CASES = "CASE lower(x) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _DICT.items()) + " END"
attack("attack_dict_subst", f"WITH {_W} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN y IS NOT NULL AND {u('dict', 'i')} < 0.2 THEN CASE WHEN regexp_matches(x, '^[A-Z]') THEN upper(substr(y, 1, 1)) || substr(y, 2) ELSE y END ELSE x END, ' ' ORDER BY i) AS t FROM (SELECT *, {_CASES} AS y FROM e) GROUP BY doc_id"), lambda t, k: A.dict_subst(t, k, _DICT))
_RANKED = f"{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {{0}}) <= greatest(1, round_even(n * 0.2, 0)) AS hit, length(x) AS l FROM e)"
_AT = uniform_sql("'114514'", ID, "CAST(i AS VARCHAR)", "'at'")
_LETTER = f"substr('abcdefghijklmnopqrstuvwxyz', CAST(floor({uniform_sql(chr(39) + '114514' + chr(39), ID, 'CAST(i AS VARCHAR)', chr(39) + 'letter' + chr(39))} * 26) AS INT) + 1, 1)"
_MODES = {
    "delete": "substr(x, 1, pos - 1) || substr(x, pos + 1)",
    "insert": f"substr(x, 1, pos) || {_LETTER} || substr(x, pos + 1)",
    "substitute": f"substr(x, 1, pos - 1) || {_LETTER} || substr(x, pos + 1)",
    "transpose": "substr(x, 1, pr - 1) || substr(x, pr + 1, 1) || substr(x, pr, 1) || substr(x, pr + 2)",
}
_PLACED = f"SELECT *, CAST(floor({_AT} * l) AS INT) + 1 AS pos, CAST(floor({_AT} * (l - 1)) AS INT) + 1 AS pr FROM r"
for _mode, _form in _MODES.items():
    attack(f"attack_typo_{_mode}", f"WITH {_RANKED.format(h('typo', 'i') + ', i')} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN hit AND l > 1 THEN {_form} ELSE x END, ' ' ORDER BY i) AS t FROM ({_PLACED}) GROUP BY doc_id"), lambda t, k, m=_mode: A.typo(t, k, m))
_U = uniform_sql("'114514'", ID, "CAST(i AS VARCHAR)", "'mode'")
_MIXED = f"CASE WHEN {_U} < 0.011 THEN {_MODES['transpose']} WHEN {_U} < 0.011 + CAST(0.23 AS DOUBLE) THEN {_MODES['delete']} WHEN {_U} < 0.011 + CAST(0.23 AS DOUBLE) + 0.556 THEN {_MODES['substitute']} WHEN {_U} < 0.011 + CAST(0.23 AS DOUBLE) + 0.556 + 0.203 THEN {_MODES['insert']} ELSE x END"
attack("attack_typo_mix", f"WITH {_RANKED.format(h('typo', 'i') + ', i')} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN hit AND l > 1 THEN {_MIXED} ELSE x END, ' ' ORDER BY i) AS t FROM ({_PLACED}) GROUP BY doc_id"), A.typo)
attack("attack_form_zero_sp", f"WITH {_RANKED.format(h('form', 'i') + ', i')} " + _OUT.format("SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN hit AND l > 1 THEN substr(x, 1, 1) || chr(8203) || substr(x, 2) ELSE x END, ' ' ORDER BY i) AS t FROM r GROUP BY doc_id"), A.zero_width)
_SE = f"s AS (SELECT doc_id, text, {SENT} AS w FROM documents), e AS (SELECT doc_id, text, len(w) AS n, i - 1 AS i, w[i] AS x FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM s))"
attack("attack_form_shift_u", f"WITH {_SE} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN hit THEN x || chr(11) || chr(11) ELSE x END, ' ' ORDER BY i) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {h('shift', 'i')}, i) <= greatest(1, round_even(n * 0.2, 0)) AS hit FROM e) GROUP BY doc_id"), A.shift_up)
attack("attack_sentence_deletion", f"WITH {_SE} SELECT doc_id, coalesce(t, text) AS attacked FROM (SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN {u('sentence', 'i')} >= 0.25 THEN x END, ' ' ORDER BY i) AS t FROM e GROUP BY doc_id)", A.drop_sentences)
_SRC, _DST = "".join(A.HOMOGLYPHS), "".join(A.HOMOGLYPHS.values())
attack("attack_homoglyph", f"WITH {_W}, l AS (SELECT *, list_filter(generate_series(1, length(x)), lambda k: regexp_matches(substr(x, k, 1), '^[A-Za-z]$')) AS ls FROM e), a AS (SELECT *, ls[CAST(floor({u('glyph', 'i')} * len(ls)) AS INT) + 1] AS pos FROM l) " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, string_agg(CASE WHEN {u('homo', 'i')} >= 0.2 THEN x WHEN len(ls) > 0 THEN substr(x, 1, pos - 1) || translate(substr(x, pos, 1), '{_SRC}', '{_DST}') || substr(x, pos + 1) END, ' ' ORDER BY i) AS t FROM a GROUP BY doc_id"), A.homoglyph)
attack("attack_span_mask", f"WITH {_W}, c AS (SELECT doc_id, n, k, row_number() OVER (PARTITION BY doc_id ORDER BY {h('span', 'k')}, k) <= floor(CAST(0.3 AS DOUBLE) * n / 4) AS hit FROM (SELECT DISTINCT doc_id, n, i // 4 AS k FROM e WHERE i // 4 < n // 4)), m AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS no FROM c WHERE hit) " + _OUT.format("SELECT e.doc_id, any_value(text) AS text, string_agg(CASE WHEN no IS NULL OR i % 4 NOT IN (1, 2) THEN x WHEN i % 4 = 1 THEN '<mask_' || CAST(no AS VARCHAR) || '>' END, ' ' ORDER BY i) AS t FROM e LEFT JOIN m ON e.doc_id = m.doc_id AND m.k = i // 4 WHERE floor(CAST(0.3 AS DOUBLE) * n / 4) > 0 GROUP BY e.doc_id"), A.mask_spans)
attack("attack_cohesiveness_deletion", f"WITH {_W}, b AS (SELECT DISTINCT doc_id, CAST(floor({u('blank', 'k')} * n) AS INT) AS i FROM (SELECT doc_id, len(w) AS n, unnest(generate_series(1, CAST(greatest(1, round_even(len(w) * 0.015, 0)) AS BIGINT))) AS k FROM w)) SELECT e.doc_id, string_agg(CASE WHEN b.i IS NULL THEN x ELSE '' END, ' ' ORDER BY e.i) AS attacked FROM e LEFT JOIN b ON e.doc_id = b.doc_id AND e.i = b.i GROUP BY e.doc_id", A.blank_words)
attack("attack_selective_deletion", f"WITH {_W} " + _OUT.format(f"SELECT doc_id, text, array_to_string(list_transform(list_filter(list_zip(w, string_split(f, '')), lambda s: s[2] <> 'D'), lambda s: s[1]), ' ') AS t FROM (SELECT doc_id, any_value(text) AS text, list(x ORDER BY i) AS w, regexp_replace(string_agg(CASE WHEN lower(x) NOT IN ('the', 'of', 'and') AND {u('selective', 'i')} < 0.2 THEN '1' ELSE '0' END, '' ORDER BY i), '1([01]{{0,3}})', 'D\\1', 'g') AS f FROM e GROUP BY doc_id)") + " AND t <> ''", lambda t, k: A.selective_drop(t, k, ["the", "of", "and"]))
query("attack_back_trans_pivot", "SELECT doc_id, CASE WHEN l = 'en' THEN 'de' WHEN l = 'ru' AND len(regexp_extract_all(text, '[Ѐ-ӿ]')) / greatest(length(text), 1) < 0.2 THEN 'de' ELSE 'en' END AS pivot FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ru' ELSE lang END AS l, CASE WHEN doc_id % 2 = 0 THEN 'Съешь ещё этих мягких булок ' ELSE '' END || substr(text, 1, 60) AS text FROM documents)")(lambda s, d: docs(s, d).select("doc_id", A.pivot_language(F.when(F.col("doc_id") % 3 == 0, "ru").otherwise(F.col("lang")), F.concat(F.when(F.col("doc_id") % 2 == 0, "Съешь ещё этих мягких булок ").otherwise(""), F.substring("text", 1, 60))).alias("pivot")))
_BATCH = {"typo": ORACLES["attack_typo_insert"], "homo": ORACLES["attack_homoglyph"].replace(">= 0.2", ">= 0.1"), "word_drop": ORACLES["attack_word_drop"]}
query("attack_batch", " UNION ALL ".join(f"SELECT doc_id AS id, '{n}' AS attack, attacked FROM ({q})" for n, q in _BATCH.items()))(lambda s, d: A.attacked(docs(s, d).withColumnRenamed("doc_id", "id").select("id", "text"), json.loads('[{"type": "typo", "mode": "insert"}, {"type": "homo", "p": 0.1}, {"type": "word_drop"}]')).select("id", "attack", "attacked"))


@query("humanize_prompt", "SELECT d.doc_id, 'Rewrite like these:' || chr(10) || (SELECT string_agg(substr(text, 1, 60), chr(10) ORDER BY sha1('114514:' || CAST(item_id AS VARCHAR))) FROM (SELECT * FROM benchmark ORDER BY sha1('114514:' || CAST(item_id AS VARCHAR)) LIMIT 3)) || chr(10) || 'Text: ' || rtrim(substr(d.text, 1, 200)) AS prompt FROM documents d")
def humanize_prompt(spark, d):
    from ..functions import rng, text
    from ..operators import sampling

    shots = sampling.exact(table(spark, d, "benchmark"), "item_id", 3).select(rng.digest(rng.SEED, F.col("item_id")).alias("h"), F.substring("text", 1, 60).alias("t"))
    pool = shots.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "t"))), lambda x: x["t"]), "\n").alias("shots"))
    return docs(spark, d).crossJoin(F.broadcast(pool)).select("doc_id", F.concat(F.lit("Rewrite like these:\n"), "shots", F.lit("\nText: "), F.rtrim(text.within_budget(F.col("text"), 50))).alias("prompt"))


@query("dict_longest_prefix", "SELECT x AS word, coalesce((SELECT t FROM (VALUES ('th', '1'), ('the', '2'), ('ti', '3'), ('tion', '4'), ('er', '5')) v(k, t) WHERE starts_with(x, k) ORDER BY length(k) DESC LIMIT 1), x) AS translated FROM (SELECT DISTINCT lower(unnest(" + WORDS + ")) AS x FROM documents)")
def dict_longest_prefix(spark, d):
    """An equi-join on the words' prefixes of the dictionary's lengths instead of a join by startswith."""
    from ..functions import text

    table_ = spark.createDataFrame([("th", "1"), ("the", "2"), ("ti", "3"), ("tion", "4"), ("er", "5")], "k string, t string")
    words = docs(spark, d).select(F.explode(text.split_words(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    prefixes = words.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.substring("word", F.lit(1), n))).alias("k")).distinct()
    best = prefixes.join(F.broadcast(table_), "k").groupBy("word").agg(F.max_by("t", F.length("k")).alias("t"))
    return words.join(best, "word", "left").select("word", F.coalesce("t", "word").alias("translated"))


query("attack_code_switch", f"WITH {_W} SELECT doc_id, string_agg(CASE WHEN starts_with(lower(x), 'the') THEN 'ZE' WHEN starts_with(lower(x), 'th') THEN 'Z' ELSE x END, ' ' ORDER BY i) AS switched FROM e GROUP BY doc_id")(lambda s, d: _switch(docs(s, d), {"th": "Z", "the": "ZE"}))


def _switch(df, table_):
    from ..functions import text

    def one(w):
        out = w
        for k in sorted(table_, key=len):
            out = F.when(F.startswith(F.lower(w), F.lit(k)), table_[k]).otherwise(out)
        return out

    words = text.split_words(F.col("text"))
    return df.where(F.size(words) > 0).select("doc_id", F.array_join(F.transform(words, one), " ").alias("switched"))


_SYN = {"the": "x", "of": "from", "thing": "matter", "oneand": "both", "que": "qui", "erer": "rere", "ing": "ong"}
_SYNC = "CASE lower(x) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SYN.items() if a not in A.STOP_WORDS) + " END"
_TOK = r"w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b]') AS w FROM documents), e AS (SELECT doc_id, text, len(w) AS n, i - 1 AS i, w[i] AS x FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) >= 4))"
_DETOK = r"regexp_replace(regexp_replace(string_agg(CASE WHEN hit THEN coalesce(" + _SYNC + r", x) ELSE x END, ' ' ORDER BY i), ' ([.,!?;:%)\]}])', '\1', 'g'), '([(\[{]) ', '\1', 'g')"
attack("attack_synonym", f"WITH {_TOK} " + _OUT.format(f"SELECT doc_id, any_value(text) AS text, {_DETOK} AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {h('syno', 'i')}, i) <= greatest(1, round_even(n * 0.2, 0)) AS hit FROM e) GROUP BY doc_id"), lambda t, k: A.synonyms(t, k, _SYN))
