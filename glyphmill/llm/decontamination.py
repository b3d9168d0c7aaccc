"""Operator 10: benchmark decontamination with training suffix arrays.

Every shard of the training text (a run of documents in one task) gets a suffix array over its words, by prefix doubling.
Every test suffix, at each word of each item, is binary-searched in it: the neighbours of its place tell the longest
verbatim match that begins with it. Where that is a window or more, a search to the depth of the window gives the range
of all places that share it, and from those that cannot be extended to the left the matches are followed to their
ends. Documents are read once and nothing is shuffled.

Words are runs of bytes other than ASCII non-alphanumerics, A-Z in lower case. A window is WINDOW
consecutive words of an item; an item of fewer words, but not none, is one window. A word that no item has ends
a suffix, and suffixes that begin with one are not in the array, as no match can begin there.

Defined results: null and empty texts have no words, no hits and are not contaminated; repeated rows are
judged each; an empty benchmark hits nothing; null item ids count as the empty string; items of one id are one item in
counts; columns of documents with any name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Bytes of test text searched for in one pass over the documents; more are searched in further passes.
BLOCK_BYTES = 16_000_000
#: Words in a shard's suffix array, about, and at least one document.
SHARD_WORDS = 1_000_000
#: Words that are compared at once.
STEP = 8

#: ASCII letters and digits and all bytes beyond ASCII make words.
_TO_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The places of ids that are not 0, in the order of the words from there on up to a 0; of equal ones, the later place first or last."""
    n = len(ids)
    place = np.flatnonzero(ids)
    order = place[np.argsort(ids[place])]
    # A rank is the first slot of the group of suffixes that are alike so far. Zeros differ from each other, so groups end with them.
    rank = -1 - np.arange(n + 1)
    slots = np.arange(len(order))
    new = np.concatenate([[True], ids[order[1:]] != ids[order[:-1]]]) if len(order) else np.empty(0, bool)
    h = 0
    while True:
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(slots)))
        rank[order[slots]] = np.repeat(slots[first], size)
        slots = slots[np.repeat(size > 1, size)]
        if not len(slots):
            return order
        h = 2 * h or 1
        at = order[slots]
        key = rank[at] * (2 * n + 4) + rank[np.minimum(at + h, n)] + n + 2
        by = np.argsort(key)
        order[slots], key = at[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])


def common_words(a: np.ndarray, at: np.ndarray, b: np.ndarray, by: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """How many words from a[at] and b[by] on agree, up to a 0 of either, for arrays of places; not more than most where that is given.

    Both end with STEP zeros at least.
    """
    out = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    steps = np.arange(STEP)
    while len(todo):
        x, y = a[(at[todo] + out[todo])[:, None] + steps], b[(by[todo] + out[todo])[:, None] + steps]
        differ = (x != y) | (x == 0)
        ended = differ.any(1)
        out[todo] += np.where(ended, differ.argmax(1), STEP)
        todo = todo[~ended if most is None else ~ended & (out[todo] < most[todo])]
    return out if most is None else np.minimum(out, most)


class Tests:
    """The suffixes of a block of test items, over a vocabulary of their own words (1, 2, ...; 0 ends an item)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        ids, item, start, left, need = [0], [], [], [], []
        for k, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            n = len(own)
            item += [k] * n
            start += range(n)
            left += range(n, 0, -1)
            need += [min(window, n)] * n
            ids += [*own, 0]
        self.ids = np.array(ids + [0] * STEP, np.int64)
        self.item, self.start, self.left, self.need = (np.array(x, np.int64) for x in (item, start, left, need))
        self.at = np.flatnonzero(self.ids)

    def place(self, shard: np.ndarray, order: np.ndarray, which: np.ndarray, most: np.ndarray | None = None, after: bool = False) -> np.ndarray:
        """The slot of each suffix of which in a shard's suffix array, by its first most words: before equal ones, or after them."""
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(order))
        todo = np.arange(len(which)) if len(order) else np.empty(0, np.int64)
        while len(todo):
            mid = (low[todo] + high[todo]) // 2
            p, t = order[mid], self.at[which[todo]]
            upto = None if most is None else most[todo]
            n = common_words(shard, p, self.ids, t, upto)
            x, y = shard[p + n], self.ids[t + n]
            equal = y == 0 if upto is None else n >= upto
            up = np.where(equal, after, x < y)
            low[todo] = np.where(up, mid + 1, low[todo])
            high[todo] = np.where(up, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        return low

    def longest(self, shard: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The length of the longest match in a shard that begins with each test suffix: the words in common with the neighbours of its slot."""
        every = np.arange(len(self.at))
        out = np.zeros(len(every), np.int64)
        if len(order) and len(every):
            slot = self.place(shard, order, every)
            for near in (slot - 1, slot):
                ok = np.flatnonzero((near >= 0) & (near < len(order)))
                out[ok] = np.maximum(out[ok], common_words(shard, order[near[ok]], self.ids, self.at[ok]))
        return out

    def search(self, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in a shard, test suffix, words) of every longest match of a window or more."""
        order = suffix_array(shard)
        which = np.flatnonzero((self.left >= self.need) & (self.longest(shard, order) >= self.need))
        need = self.need[which]
        first, last = self.place(shard, order, which, need), self.place(shard, order, which, need, after=True)
        count = last - first
        suffix = np.repeat(which, count)
        at = order[np.repeat(first, count) + np.arange(len(suffix)) - np.repeat(np.cumsum(count) - count, count)]
        before = shard[at - 1]  # a shard begins with a 0
        whole = (before == 0) | (before != self.ids[self.at[suffix] - 1])
        at, suffix = at[whole], suffix[whole]
        return at, suffix, common_words(shard, at, self.ids, self.at[suffix])


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end), sorted and joined where they overlap or touch."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(spans) - 1]])]], 1)


def searched(tests: Tests, texts: list[bytes], locate: bool) -> list[tuple[int, np.ndarray, list[str], list[dict]]]:
    """For each document of a shard: its words, its merged spans, the items found and the longest matches."""
    get = tests.vocabulary.get
    split = [np.fromiter(map(get, own := words(t), repeat(0)), np.int64, len(own)) for t in texts]
    starts = 1 + np.concatenate([[0], np.cumsum([len(x) + 1 for x in split])])
    ids = np.zeros(starts[-1] + STEP, np.int64)
    for s, x in zip(starts, split, strict=False):
        ids[s : s + len(x)] = x
    at, suffix, length = tests.search(ids)
    doc = np.searchsorted(starts, at, "right") - 1
    order = np.lexsort((at, doc))
    at, suffix, length, doc = at[order], suffix[order], length[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, x in enumerate(split):
        lo, hi = bounds[k], bounds[k + 1]
        if lo == hi:
            out.append((len(x), np.empty((0, 2), np.int64), [], []))
            continue
        own, which = at[lo:hi] - starts[k], suffix[lo:hi]
        spans = _merged(np.stack([own, own + length[lo:hi]], 1))
        item = [tests.names[i] for i in tests.item[which].tolist()]
        rows = zip(item, own.tolist(), tests.start[which].tolist(), length[lo:hi].tolist(), strict=True)
        matches = [{"item": i, "doc_start": a, "item_start": b, "length": n} for i, a, b, n in rows] if locate else []
        out.append((len(x), spans, sorted(set(item)), matches))
    return out


def shards(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (start, rows) of a batch's texts of some SHARD_WORDS words each, and at least one text."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 4 + 1)
    at = 0
    while at < len(upto):
        end = min(1 + int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARD_WORDS)), len(upto))
        yield at, end - at
        at = end


STATE = (("__words", "long"), ("__hits", "array<int>"), ("__items", "array<string>"), ("__matches", "array<struct<item:string,doc_start:int,item_start:int,length:int>>"))


_LISTS = [pa.list_(k) for k in (pa.int32(), pa.string(), pa.struct([("item", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))]


def searched_batch(tests: Tests, batch: pa.RecordBatch, at_text: int, n_own: int, locate: bool) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, with what tests find added to the STATE that follows n_own columns. A batch for each shard: no more texts are Python objects at once."""
    texts = batch.column(at_text).cast(pa.binary())
    for at, n in shards(texts):
        rows = batch.slice(at, n)
        done = searched(tests, [t or b"" for t in texts.slice(at, n).to_pylist()], locate)
        old = [rows.column(n_own + k).to_pylist() for k in (1, 2, 3)]
        hits = [_merged(np.concatenate([np.array(a, np.int64).reshape(-1, 2), d[1]])).ravel().tolist() if a else d[1].ravel().tolist() for a, d in zip(old[0], done, strict=True)]
        items = [sorted({*a, *d[2]}) for a, d in zip(old[1], done, strict=True)]
        matches = [[*a, *d[3]] for a, d in zip(old[2], done, strict=True)]
        new = [pa.array([d[0] for d in done], pa.int64()), *(pa.array(v, k) for v, k in zip((hits, items, matches), _LISTS, strict=True))]
        yield pa.RecordBatch.from_arrays([*rows.columns[:n_own], *new], names=batch.schema.names[: n_own + len(STATE)])


def names(docs: DataFrame) -> list[str]:
    """The columns that matched() adds: __words, __hits, __items and __matches, with underscores at the end where docs has those."""
    return common.unused(docs, *[n for n, _ in STATE])


def matched(docs: DataFrame, benchmark: DataFrame, text: str = "text", locate: bool = True, window: int = WINDOW) -> DataFrame:
    """docs with the number of words, the hit words (flat starts and ends), the items and, if located, the longest matches of a window or
    more, in columns named by names()."""
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), common.text_or_empty("text").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    own_names = names(docs)
    empty = [(F.lit(0) if kind == "long" else F.array()).cast(kind).alias(n) for n, (_, kind) in zip(own_names, STATE, strict=True)]
    state = docs.select("*", *empty)
    schema = state.schema
    n_own = len(docs.columns)
    # A column of strings is sent once; only one of another type goes along a second time, as a string.
    given = [k for k, (c, kind) in enumerate(docs.dtypes) if c == text and kind == "string"]
    more = [] if len(given) == 1 else [F.col(text).cast("string").alias(common.unused(state, "__text")[0])]
    at_text = given[0] if not more else len(schema)
    for block in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.collect()])  # BLOCK_BYTES or one item

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block_tests = Tests(sent.value, window)
            for batch in batches:
                yield from searched_batch(block_tests, batch, at_text, n_own, locate)

        state = state.select("*", *more).mapInArrow(run, schema)
        if block < blocks - 1:
            state = common.durable(state, "searched")
    return state


def n_hit(hits: str = "__hits"):
    """Hit words: the sum of the merged spans' lengths."""
    return F.aggregate(F.transform(hits, lambda x, k: F.when(k % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated(n_words: str = "__words", hits: str = "__hits"):
    """A document is contaminated if at least one word in twenty is hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(n_words))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones, with their own columns only."""
    n_words, hits, _, _ = names(docs)
    return matched(docs, benchmark, text, locate=False).where(~contaminated(n_words, hits)).select([F.col(f"`{c}`") for c in docs.columns])


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matched(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("__words").alias("n_words"), n_hit().alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("__items")), 256).alias("items_sha256"), contaminated().alias("contaminated"))


ORACLE = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split_regex(regexp_replace(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), '^ | $', '', 'g'), ' ') AS w0 FROM documents),
dw AS (SELECT doc_id, r, list_filter(w0, lambda x: x <> '') AS w FROM d),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[s:s + least(13, len(w)) - 1], ' ') AS win FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dwin AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT dwin.r, s, iw.n, item FROM dwin JOIN iw ON dwin.win = iw.win AND dwin.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
