"""Operator 12: an audit of how sources diverge in their words, by mergeable radix tries.

Every task counts the terms of its documents, source by source, and puts them into one radix trie over UTF-8 bytes for each language; a
leaf has the number of documents and a counter for each source. A node below which there are few terms is a bucket of their ends; one that is
full forks by the next byte, below the bytes that all its terms share. A trie is traversed in byte order and written bucket by bucket. The
buckets' first terms are a sample of all leaves, and its quantiles cut (language, term) into ranges, more where there are more leaves, so that a
frequent language or prefix is many ranges. Buckets are cut there, and those of a range meet in one task, which merges them into one trie
and traverses it: these are the kept terms with their counts. A second pass over the kept terms sums the divergences of all pairs of
sources and keeps each group's best candidates, ties by UTF-8.

All arithmetic is in whole numbers. The sources of a language, whose pairs are the result, are sent to every task (MOST_GROUPS at most,
beyond that it is an error); nothing else that grows is, but for the cuts, SAMPLE at most.

Defined results: null text, lang and source count as ''; every row is a document of its own, repeated ids and rows too; ids and
other columns are not read; a language whose only source it is has no pairs; a group without terms diverges by its smoothed shares;
without kept terms all pairs are 0; an empty table gives an empty result. Terms are bytes, of any length and script.
"""

from __future__ import annotations

import bisect
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice
from os.path import commonprefix
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .exact_dedup import LOWER, UPPER

#: Different terms, and bytes of texts, at which a task's tries are written and started anew; terms of a bucket; leaves that a range is to have.
LEAVES, TEXT_BYTES, BUCKET, RANGE = 1 << 18, 64_000_000, 2048, 1 << 17
#: Buckets that the cuts are taken from, and bytes of a cut at most.
SAMPLE, CUT_BYTES = 1 << 20, 256
#: Documents of a language that a term must be in; candidates of a group; groups of a language and source at most.
LEAST_DOCS, TOP, MOST_GROUPS = 3, 200, 100_000
#: Entries of a block of terms by sources.
ENTRIES = 1 << 20
SHARE = 10**9

#: Letters A-Z in lower case, all bytes that are in no term as spaces.
_TERMS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Occurrences by source; under no name, the number of documents.
Counts = dict[str | None, int]
#: A prefix, and the ends of the terms that have it with their counts, in order.
Run = tuple[bytes, list[tuple[bytes, Counts]]]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


class Fork:
    """Terms that go on with label; by the byte after it a bucket (of what comes after that byte) or another fork. own: the term that ends with label."""

    __slots__ = ("label", "below", "own")

    def __init__(self, label: bytes, below: dict, own: Counts | None):
        self.label, self.below, self.own = label, below, own


def forked(bucket: dict[bytes, Counts]) -> Fork:
    label = commonprefix([min(bucket), max(bucket)])
    below, at = defaultdict(dict), len(label)
    own = bucket.pop(label, None)
    for end, counts in bucket.items():
        below[end[at]][end[at + 1 :]] = counts
    return Fork(label, dict(below), own)


def added(to: Counts, counts: Counts) -> None:
    for source, n in counts.items():
        to[source] = to.get(source, 0) + n


class Trie:
    """A radix trie over bytes whose lowest nodes are buckets."""

    def __init__(self) -> None:
        self.root: Fork | dict[bytes, Counts] = {}

    def add(self, term: bytes, counts: Counts) -> None:
        """Adds to the term's counts; the trie may keep the given ones as its own."""
        node, at, above, byte = self.root, 0, None, 0
        while type(node) is Fork:
            label = node.label
            if not term.startswith(label, at):
                common_part = commonprefix([label, term[at:]])
                k = len(common_part)
                lower = Fork(label[k + 1 :], node.below, node.own)
                node = self._put(above, byte, Fork(common_part, {label[k]: lower}, None))
                label = common_part
            at += len(label)
            if at == len(term):
                if node.own is None:
                    node.own = counts
                else:
                    added(node.own, counts)
                return
            above, byte = node, term[at]
            at += 1
            node = node.below.get(byte)
            if node is None:
                node = above.below[byte] = {}
        found = node.get(end := term[at:])
        if found is not None:
            added(found, counts)
            return
        node[end] = counts
        if len(node) > BUCKET:
            self._put(above, byte, forked(node))

    def _put(self, above: Fork | None, byte: int, node: Fork) -> Fork:
        if above is None:
            self.root = node
        else:
            above.below[byte] = node
        return node

    def runs(self) -> Iterator[Run]:
        """The leaves in byte order of their terms, which is that of UTF-8 code points, bucket by bucket."""
        stack: list[tuple[bytes, Fork | dict[bytes, Counts]]] = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            if type(node) is not Fork:
                if node:
                    yield prefix, sorted(node.items())
                continue
            prefix += node.label
            if node.own is not None:
                yield prefix, [(b"", node.own)]
            stack += [(prefix + bytes([b]), node.below[b]) for b in sorted(node.below, reverse=True)]


def small(numbers: list[int]) -> np.ndarray:
    """In as few bytes each as the largest needs."""
    return np.array(numbers, np.min_scalar_type(max(numbers, default=0)))


def packed(run: Run) -> bytes:
    prefix, leaves = run
    names: dict[str | None, int] = {None: 0}
    ends, counts = zip(*leaves, strict=True)
    which = [names.setdefault(s, len(names)) for c in counts for s in c]
    return pickle.dumps((prefix, list(names), b"".join(ends), small(list(map(len, ends))), small(list(map(len, counts))), small(which), small([n for c in counts for n in c.values()])))


def unpacked(body: bytes) -> Run:
    prefix, names, ends, sizes, entries, which, counts = pickle.loads(body)
    upto = list(accumulate(sizes.tolist(), initial=0))
    pairs = zip([names[k] for k in which.tolist()], counts.tolist(), strict=True)
    return prefix, [(ends[a:b], dict(islice(pairs, n))) for a, b, n in zip(upto, upto[1:], entries.tolist(), strict=False)]


def as_batch(rows: Iterable[tuple], **columns: pa.DataType) -> pa.RecordBatch:
    rows = list(rows)
    by_column = zip(*rows, strict=True) if rows else [[] for _ in columns]
    return pa.record_batch([pa.array(c, t) for c, t in zip(by_column, columns.values(), strict=True)], names=list(columns))


_RUNS = "lang string, first binary, last binary, leaves long, body binary"


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The buckets of the tries of documents (lang, source, text in bytes)."""

    def full() -> Iterator[pa.RecordBatch]:
        for lang, of_docs in docs.items():
            leaves = {term: {None: n} for term, n in of_docs.items()}
            for source, counts in terms[lang].items():
                for term, n in counts.items():
                    leaves[term][source] = n
            trie = Trie()
            for term, counts in leaves.items():
                trie.add(term, counts)
            rows = ((lang, p + leaf[0][0], p + leaf[-1][0], len(leaf), packed((p, leaf))) for p, leaf in trie.runs())
            while some := list(islice(rows, common.BATCH_ROWS)):
                yield as_batch(some, lang=pa.string(), first=pa.binary(), last=pa.binary(), leaves=pa.int64(), body=pa.binary())

    docs, terms, size = defaultdict(Counter), defaultdict(lambda: defaultdict(Counter)), 0
    for batch in common.batches(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = terms_of(text)
            docs[lang].update(set(found))
            terms[lang][source].update(found)
            size += len(text)
            if sum(map(len, docs.values())) > LEAVES or size > TEXT_BYTES:
                yield from full()
                docs.clear()
                terms.clear()
                size = 0
    yield from full()


def ranged(given: Iterable[pa.RecordBatch], cuts: list[tuple[str, bytes]]) -> Iterator[pa.RecordBatch]:
    """(range, lang, body) of buckets, cut where ranges end."""
    columns = {"range": pa.int64(), "lang": pa.string(), "body": pa.binary()}
    for batch in common.batches(given):
        out = []
        for lang, first, last, body in zip(*(batch.column(c).to_pylist() for c in ("lang", "first", "last", "body")), strict=True):
            low = bisect.bisect(cuts, (lang, first))
            if low == bisect.bisect(cuts, (lang, last)):
                out.append((low, lang, body))
                continue
            prefix, leaves = unpacked(body)
            parts = defaultdict(list)
            for leaf in leaves:
                parts[bisect.bisect(cuts, (lang, prefix + leaf[0]))].append(leaf)
            out += [(k, lang, packed((prefix, part))) for k, part in parts.items()]
        yield as_batch(out, **columns)


def merged(of_range: pd.DataFrame) -> pd.DataFrame:
    """The kept terms of a range, from one trie for each of its languages."""
    tries = defaultdict(Trie)
    for lang, body in zip(of_range["lang"], of_range["body"], strict=True):
        add = tries[lang].add
        prefix, leaves = unpacked(body)
        for end, counts in leaves:
            add(prefix + end, counts)
    rows = []
    for lang, trie in tries.items():
        for prefix, leaves in trie.runs():
            for end, counts in leaves:
                if counts.pop(None) >= LEAST_DOCS:
                    rows.append((lang, prefix + end, list(counts), list(counts.values())))
    return pd.DataFrame(rows, columns=["lang", "term", "sources", "counts"])


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, sources, counts) of the terms in LEAST_DOCS documents of docs (lang, source, text, without nulls); durable."""
    spark = docs.sparkSession
    written = common.durable(docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(counted, _RUNS), "runs")
    total = written.agg(F.sum("leaves")).first()[0] or 0
    some = written.select("lang", F.substring("first", 1, CUT_BYTES).alias("first"), "leaves").orderBy(F.xxhash64("lang", "first")).limit(SAMPLE)
    sample = sorted((r.lang, bytes(r.first), r.leaves) for r in some.collect())
    n = max(4 * common.shuffle_parts(spark), -(-total // RANGE))
    upto = list(accumulate(r[2] for r in sample))
    cuts = sorted({sample[bisect.bisect(upto, k * upto[-1] // n)][:2] for k in range(1, n)}) if sample else []
    of_ranges = written.mapInArrow(lambda batches: ranged(batches, cuts), "range long, lang string, body binary")
    return common.durable(of_ranges.groupBy("range").applyInPandas(merged, "lang string, term binary, sources array<string>, counts array<long>"), "kept", up=1)


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(SHARE * (counts + 1) / whole), in long division of three digits at a time, so that no product leaves a long."""
    quotient, rest = np.divmod(counts + 1, whole)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        quotient = quotient * 1000 + digits
    return quotient + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


#: Of each language: V, and N of each of its sources.
Totals = dict[str, tuple[int, dict[str, int]]]
_PARTS = "lang string, source string, part string, item binary, value long"


def compared(given: Iterable[pa.RecordBatch], totals: Totals) -> Iterator[pa.RecordBatch]:
    """Sums of all pairs over a task's kept terms, and its TOP candidates of each group."""
    places = {lang: {s: k for k, s in enumerate(n)} for lang, (_, n) in totals.items()}
    wholes = {lang: np.array(list(n.values()), np.int64) + v for lang, (v, n) in totals.items()}
    sums, best = {}, defaultdict(list)
    for batch in given:
        columns = [c.to_pylist() for c in batch.columns]
        by_lang = defaultdict(list)
        for row in zip(*columns, strict=True):
            by_lang[row[0]].append(row[1:])
        for lang, rows in by_lang.items():
            place, whole = places[lang], wholes[lang]
            step = max(1, ENTRIES // len(place))
            for a in range(0, len(rows), step):
                some = rows[a : a + step]
                counts = np.zeros((len(some), len(place)), np.int64)
                for k, (_, sources, of_source) in enumerate(some):
                    counts[k, [place[s] for s in sources]] = of_source
                p = shares(counts, whole)
                if lang not in sums:
                    sums[lang] = np.zeros((len(place), len(place)), np.int64)
                for k in range(len(place)):
                    sums[lang][k] += divergence(p[:, k : k + 1], p).sum(0)
                q = shares(counts.sum(1), int((whole - totals[lang][0]).sum()) + totals[lang][0])
                for source, k in place.items():
                    over = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
                    value = divergence(p[over, k], q[over])
                    if len(value) > TOP:
                        high = value >= np.partition(value, len(value) - TOP)[len(value) - TOP]
                        over, value = over[high], value[high]
                    held = best[lang, source]
                    held += zip((-value).tolist(), [some[t][0] for t in over.tolist()], strict=True)
                    held.sort()
                    del held[TOP:]
    pairs = ((lang, a, "pair", b.encode(), int(sums[lang][i, j])) for lang in sums for a, i in places[lang].items() for b, j in places[lang].items() if i != j)
    terms = ((lang, source, "term", term, -value) for (lang, source), held in best.items() for value, term in held)
    types: dict[str, Any] = {"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.binary(), "value": pa.int64()}
    for rows in (pairs, terms):
        while some := list(islice(rows, 10_000)):
            yield as_batch(some, **types)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of each language are apart, and by which terms."""
    spark = docs.sparkSession
    docs = docs.select(*[common.text_or_empty(c).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    with common.scratch(spark, "audit"):
        kept = kept_terms(docs)
    occurring = docs.select("lang", "source").distinct()
    counts = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("e")).groupBy("lang", F.col("e.sources").alias("source")).agg(F.sum("e.counts").alias("n"))
    groups = occurring.join(counts, ["lang", "source"], "left").join(kept.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left").orderBy("lang", "source").limit(MOST_GROUPS + 1).collect()
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups of language and source: their pairs cannot be compared in one task's memory")
    totals: Totals = {}
    for r in groups:
        totals.setdefault(r.lang, (r.v or 0, {}))[1][r.source] = r.n or 0
    own = spark.createDataFrame([(r.lang, r.source) for r in groups], "lang string, source string")
    parts = kept.mapInArrow(lambda batches: compared(batches, totals), _PARTS).withColumn("item", F.col("item").cast("string"))
    parts = common.durable(parts, "parts")
    pairs = own.join(own.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = pairs.join(parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= TOP))


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(common.table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, 1 + ({SHARE} * (coalesce(c, 0) + 1)::HUGEINT) // (n + v) AS p
      FROM kept JOIN g USING (lang) JOIN n USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + ({SHARE} * (sum(c) + 1)::HUGEINT) // ((SELECT sum(n) FROM n WHERE n.lang = p.lang) + any_value(v)) AS q
      FROM p JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM all_pairs
UNION ALL SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms QUALIFY rank <= {TOP}
"""
