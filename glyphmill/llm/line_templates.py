"""Operator 3: line dedup by a tree of log templates, in DataFrame functions only.

Every line is parsed to a leaf of a tree of fixed depth: its number of tokens, then its leading tokens; a token
with a digit is a variable field from the start. In a leaf that holds VALUES different lines or more, each
position's most frequent token makes the leaf's template, and a position with VALUES different tokens or more
varies like a field. Lines that differ from the template in such positions only, and agree with it in enough of the
positions below the tree's leading tokens, belong to it. Any other line is a template of its own, but for its fields.

A line goes if it recurs word for word in DOCUMENTS documents or more, or its template, if that has fields, recurs
in FIELD_DOCUMENTS or more; it stays in the first document (by id) that has the line, or the template. Lines that differ
in words alone are therefore dropped only if those words vary as widely as names and numbers do.

Defined results: null and empty texts stay as they are (null: empty); blank lines are kept; lines of fewer than
LEAST_TOKENS tokens, or with less than CONSTANT of them without digits, have no template and recur only word for word;
lines that recur in one document only are kept; a line of any length is compared whole; rows that repeat an id and
its text count as one document and get the same result; rows without an id are documents, the first ones; columns of
documents with any name are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Leading tokens in the tree; the share of positions below them in which a line must agree with its leaf's template.
DEPTH, ALIKE = 4, 0.8
#: Tokens in a line that can have a template, at least, and the share of them without digits.
LEAST_TOKENS, CONSTANT = 5, 0.5
#: Documents in which a line recurs word for word, and in which a template with fields recurs, at least.
DOCUMENTS, FIELD_DOCUMENTS = 2, 5
#: Different tokens in a position that varies like a field, at least.
VALUES = 8

FIELD = "<*>"


def folded(line: Column, of: Column) -> Column:
    """of, made of line, with single spaces. Most lines have no other white space."""
    return F.trim(F.when(F.contains(line, F.lit("  ")) | line.rlike(r"[\t\r\f\x0B]"), F.regexp_replace(of, r"[ \t\r\f\x0B]+", " ")).otherwise(of))


def masked(line: Column) -> Column:
    """A line with single spaces and with variable fields for its tokens with a digit. Most lines have none."""
    return folded(line, F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"(?<!\S)[^\s0-9]*+[0-9]\S*+", FIELD)).otherwise(line))


def parsed(docs: DataFrame) -> DataFrame:
    """(doc, key, line, plain, masked, n, open) of the lines of docs (doc, key, text) that are not blank; open lines can have a template."""
    # Masked inside the generator: as a column of a projection it would be computed again in the filter and for each use.
    rows = docs.select("doc", "key", F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.struct(masked(x).alias("masked"), folded(x, x).alias("plain")))).alias("line", "of"))
    rows = rows.select("doc", "key", "line", "of.masked", "of.plain").where("masked <> ''")
    rows = rows.withColumn("n", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1)
    fields = F.when(F.contains("masked", F.lit(FIELD)), F.regexp_count("masked", F.lit(r"(?<!\S)<\*>(?!\S)"))).otherwise(0)
    return rows.withColumn("open", (F.col("n") >= LEAST_TOKENS) & (fields <= (1 - CONSTANT) * F.col("n")))


def generalised(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(leaf, body) of the open lines that belong to their leaf's template and are not that template themselves or alone in it."""
    bodies = lines.where("open").groupBy("leaf", "body").agg(F.count("*").alias("weight"), F.min(F.struct("doc", "key")).alias("first"))
    bodies = common.durable(bodies, "bodies")
    leaves = bodies.groupBy("leaf").agg(F.count("*").alias("bodies")).where(F.col("bodies") >= VALUES).select("leaf")
    # One document with every line of those leaves is enough to see its tokens.
    shown = common.durable(bodies.join(common.sized(common.durable(leaves, "leaves")), "leaf", "left_semi").select("leaf", "body", "weight", "first.*"), "shown")
    ids = common.durable(shown.select("doc", "key").distinct(), "ids")
    texts = docs.join(common.sized(ids), docs["doc"].eqNullSafe(ids["doc"]) & (docs["key"] == ids["key"]), "left_semi")
    found = hashed(parsed(texts)).where("open").select("leaf", "body", "n", "masked").dropDuplicates(["leaf", "body"]).join(shown.select("leaf", "body", "weight"), ["leaf", "body"])
    fields = common.durable(found.select("leaf", "body", "weight", "n", F.posexplode(F.split("masked", " ")).alias("at", "token")).where(F.col("at") >= DEPTH), "fields")
    counted = fields.groupBy("leaf", "at", "token").agg(F.sum("weight").alias("weight"))
    template = counted.groupBy("leaf", "at").agg(F.min(F.struct(-F.col("weight"), "token")).getField("token").alias("usual"), (F.count("*") >= VALUES).alias("varies"))
    same = F.col("token") == F.col("usual")
    agree = fields.join(template, ["leaf", "at"]).groupBy("leaf", "body").agg(F.sum(same.cast("int")).alias("same"), F.max("n").alias("n"), F.every(same | F.col("varies")).alias("fits"))
    belong = agree.where(F.col("fits") & (F.col("same") >= ALIKE * (F.col("n") - DEPTH))).select("leaf", "body")
    # A leaf whose only member is the template itself generalises nothing.
    several = belong.groupBy("leaf").count().where("count > 1").select("leaf")
    return belong.join(several, "leaf", "left_semi")


def hashed(lines: DataFrame) -> DataFrame:
    """lines with the hashes word and more (of the line), leaf and body (of an open line's template)."""
    return lines.withColumns({
        "word": F.xxhash64("plain"),
        "more": F.xxhash64(F.lit("line"), "plain"),
        "leaf": F.when(F.col("open"), F.xxhash64("n", F.substring_index("masked", " ", DEPTH))),
        "body": F.when(F.col("open"), F.xxhash64("masked")),
        "field": F.col("open") & F.contains("masked", F.lit(FIELD)),
    })


def recurring(lines: DataFrame, on: list[str], name: str, documents: int) -> DataFrame:
    """(doc, key, line) of the lines whose value of on recurs in so many documents, but for the first document that has it."""
    own = F.struct("doc", "key")
    if documents == 2:  # two documents are seen from the least and the greatest
        counted = lines.groupBy(*on).agg(F.count("*").alias("__n"), F.min(own).alias("first"), F.max(own).alias("last")).where("first <> last").drop("last")
    else:
        per = lines.groupBy(*on, "doc", "key").agg(F.count("*").alias("lines"))
        counted = per.groupBy(*on).agg(F.sum("lines").alias("__n"), F.min(own).alias("first"), F.count("*").alias("documents")).where(F.col("documents") >= documents).drop("documents")
    counted = common.durable(counted, name)
    found = common.joined_hot(lines, counted, on, lines.count())
    return found.where(~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("key") == F.col("first.key")))).select("doc", "key", "line")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc, key, lines, unsure): the numbers of the lines to drop from each document of docs (doc, key, text), and of those
    that another document is not sure to keep word for word."""
    lines = common.durable(hashed(parsed(docs)).select("doc", "key", "line", "word", "more", "leaf", "body", "open", "field"), "lines")
    wide = common.durable(generalised(docs, lines), "belong")
    n_wide = wide.count()
    templates = lines.where("field").select("doc", "key", "line", "leaf", "body")
    if n_wide:
        told = wide.withColumn("wide", F.lit(True))
        rows = lines.where("open").join(common.sized(told, n_wide), ["leaf", "body"], "left").where("field OR wide")
        templates = rows.select("doc", "key", "line", "leaf", F.when(F.col("wide"), F.lit(0).cast("long")).otherwise(F.col("body")).alias("body"))
    templates = common.durable(templates, "templates")
    exact = recurring(lines.select("doc", "key", "line", "word", "more"), ["word", "more"], "words", DOCUMENTS).withColumn("unsure", F.lit(False))
    loose = recurring(templates, ["leaf", "body"], "recurring", FIELD_DOCUMENTS).withColumn("unsure", F.lit(True))
    gone = exact.unionByName(loose)
    return gone.groupBy("doc", "key").agg(F.collect_set("line").alias("lines"), F.collect_set(F.when(F.col("unsure"), F.col("line"))).alias("unsure"))


def marked(docs: DataFrame, doc: str, text: str, lines: str, unsure: str) -> DataFrame:
    """docs with the numbers of the lines to drop, or null, in a column lines, and the unsure ones of them in another."""
    own, k_doc, k_key = F.xxhash64(F.lit("document"), common.text_or_empty(text)), *common.unused(docs, "__doc", "__key")
    small = docs.select(F.col(doc).alias("doc"), own.alias("key"), common.text_or_empty(text).alias("text"))
    with common.scratch(docs.sparkSession, "line_dedup"):
        gone = common.durable(dropped_lines(small), "dropped", up=1)
    n_gone = gone.agg(F.sum(1 + F.size("lines") + F.size("unsure"))).first()[0] or 0  # numbers of lines, so that the bound holds for their bytes
    gone = gone.withColumnsRenamed({"doc": k_doc, "key": k_key, "lines": lines, "unsure": unsure})
    out = docs.join(common.sized(gone, n_gone), docs[doc].eqNullSafe(gone[k_doc]) & (own == gone[k_key]), "left")
    return out.select(*[docs[c] for c in docs.columns], lines, unsure)


def left_over(text: str, gone: str) -> Column:
    """text (null: empty) without the lines of the numbers in a column gone, which may be null."""
    split = F.split(common.text_or_empty(text), "\n")
    return F.when(F.col(gone).isNull(), common.text_or_empty(text)).otherwise(F.array_join(F.filter(split, lambda x, k: ~F.array_contains(gone, k)), "\n"))


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text without the dropped lines, and __lines and __dropped (or those names with underscores at the end, if docs has
    them): how many it had and lost."""
    gone, unsure, n_lines, n_dropped = common.unused(docs, "__gone", "__unsure", "__lines", "__dropped")
    rows = marked(docs, doc, text, gone, unsure)
    counts = (F.size(F.split(common.text_or_empty(text), "\n")).alias(n_lines), F.coalesce(F.size(gone), F.lit(0)).alias(n_dropped))
    return rows.select(*[left_over(text, gone).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], *counts)


def without_recurring(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without recurring lines. A document goes if nothing is left of it and all of its lines stand word for word in documents that
    keep them; one whose lines recur as templates only keeps those lines; one that was blank before stays as it is."""
    gone, unsure = common.unused(docs, "__gone", "__unsure")
    rows = marked(docs, doc, text, gone, unsure)
    bare = F.col(gone).isNotNull() & (F.trim(F.regexp_replace(left_over(text, gone), r"\s+", "")) == "")
    rows = rows.where(~(F.coalesce(bare, F.lit(False)) & (F.size(unsure) == 0)))
    rows = rows.withColumn(gone, F.when(bare, F.array_except(gone, unsure)).otherwise(F.col(gone)))
    return rows.select(*[left_over(text, gone).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "text", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, k - 1 AS line, ls[k] AS t FROM (SELECT doc_id, ls, unnest(generate_series(1, len(ls))) AS k FROM d)),
tok AS (SELECT doc_id, line, plain, list_transform(string_split(plain, ' '), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM (SELECT doc_id, line, trim(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g')) AS plain FROM l) WHERE plain <> ''),
p AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS body, len(w) AS n, array_to_string(w[1:4], ' ') AS lead, array_to_string(w, ' ') LIKE '%<*>%' AS field FROM tok WHERE len(w) >= 5 AND len(list_filter(w, lambda x: x = '<*>')) <= 0.5 * len(w)),
b AS (SELECT n, lead, body, any_value(w) AS w, count(*) AS weight FROM p GROUP BY n, lead, body),
s AS (SELECT n, lead FROM b GROUP BY n, lead HAVING count(*) >= 8),
f AS (SELECT n, lead, body, weight, k, w[k] AS token FROM (SELECT b.*, unnest(generate_series(5, b.n)) AS k FROM b JOIN s USING (n, lead))),
v AS (SELECT n, lead, k, token, sum(weight) AS weight FROM f GROUP BY n, lead, k, token),
m AS (SELECT n, lead, k, token AS usual, tokens >= 8 AS varies FROM (SELECT *, count(*) OVER (PARTITION BY n, lead, k) AS tokens, row_number() OVER (PARTITION BY n, lead, k ORDER BY weight DESC, token) AS r FROM v) WHERE r = 1),
a0 AS (SELECT n, lead, body FROM f JOIN m USING (n, lead, k) GROUP BY n, lead, body HAVING bool_and(token = usual OR varies) AND sum(CASE WHEN token = usual THEN 1 ELSE 0 END) >= 0.8 * (n - 4)),
a AS (SELECT * FROM a0 QUALIFY count(*) OVER (PARTITION BY n, lead) > 1),
t AS (SELECT p.doc_id, p.line, p.n, p.lead, CASE WHEN a.body IS NULL THEN p.body ELSE NULL END AS body FROM p LEFT JOIN a ON p.n = a.n AND p.lead = a.lead AND p.body = a.body WHERE p.field OR a.body IS NOT NULL),
r AS (SELECT n, lead, body, min(doc_id) AS first FROM t GROUP BY n, lead, body HAVING count(DISTINCT doc_id) >= 5),
e AS (SELECT plain, min(doc_id) AS first FROM tok GROUP BY plain HAVING count(DISTINCT doc_id) >= 2),
x AS (SELECT t.doc_id, t.line FROM t JOIN r ON t.n = r.n AND t.lead = r.lead AND t.body IS NOT DISTINCT FROM r.body WHERE t.doc_id <> r.first UNION SELECT tok.doc_id, tok.line FROM tok JOIN e USING (plain) WHERE tok.doc_id <> e.first),
g AS (SELECT doc_id, list(line) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_transform(list_filter(generate_series(1, len(ls)), lambda k: NOT list_contains(gone, k - 1)), lambda k: ls[k]), chr(10)) END AS text, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped
FROM d LEFT JOIN g USING (doc_id)
"""
