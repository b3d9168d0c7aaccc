"""Operator 8: exact n-gram Jaccard self-join by T-occurrence search.

Equal shingle sets collapse to one class first. For the rest, signatures bring together every two sets
that can reach the threshold. High thresholds sign by pigeonhole: a set's shingles are dealt by hash into
more parts than linked sets can differ in shingles, so two such sets agree on a whole part, whose hash is
a signature. Lower thresholds sign with the rarest shingles (prefix filter). How often a shingle occurs is
told by a sketch of fixed size over all documents; it only orders and weighs, so its errors cost time, not
links. Sets with a common signature (directly or through others) are a family. A family is cut by size into
ranges, so that links stay in a range or join neighbouring ones, and ranges into blocks of at most BLOCK_SETS sets.
Every block is searched in itself with DivideSkip: the short inverted lists of a query are merged through a
heap, the long ones probed by binary search, and the sets that occur in T lists, T being the overlap that the
threshold asks for, are links. The first set of each range (its pivot) visits the blocks of its range and of the
next, which connects a large group of near copies across blocks. Only blocks that hold sets of different components
after that are searched pair by pair. A query skips sets that are connected with it already, so a family of m
mutually similar sets gives some m links, not m * m, and its sets are sent to one block each.

Two sets link when den * intersection >= num * union. Every link between different components is found;
those inside a component suffice to connect it.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and are their own
component; texts of fewer words than a shingle are one shingle; repeated rows are equal sets; columns of
documents other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .shingle_sets import WordHash, mixed, set_key, shingles

#: Sizes of a level grow by this factor.
LEVEL = 1.5
#: Thresholds with (den - num) / (den + num) up to this sign whole parts, others rare shingles.
PARTS_UP_TO = 0.06
#: Counters of the sketch of shingle frequencies, and how many are in a row of it.
SKETCH_BITS, SKETCH_ROW = 20, 1024
#: Bits that mark the rare shingles which several sets turned out to sign with, and how often signing is repeated without them.
SHARED_BITS, REFINED = 26, 1
#: Sets and shingles in a block.
BLOCK_SETS, BLOCK_SHINGLES = 1500, 600_000
#: Components probed through one of their sets before a search, in blocks of more than this many sets.
PROBE_ABOVE, PROBES = 32, 4


def bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


class Sketch:
    """How many documents have a shingle, at most: counts by bucket. shared: bits of shingles that several sets have for sure."""

    def __init__(self, counts: np.ndarray, shared: np.ndarray | None = None):
        self.counts, self.shared = counts, shared
        usual = float(np.median(counts))
        self.often = usual + 6 * math.sqrt(usual) + 6

    def order(self, found: np.ndarray) -> np.ndarray:
        """A number for each shingle, the smaller the rarer: first those not known to be shared."""
        count = self.counts[bucket(found)].astype(np.int64)
        if self.shared is None:
            return count
        at = (found & np.uint64((1 << SHARED_BITS) - 1)).astype(np.int64)
        return count + ((self.shared[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(np.int64) << 40)


class Parts:
    """Levels of set sizes and the number of parts in each, for sets that link at num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.by_prefix = den - num > PARTS_UP_TO * (den + num)
        self.tops = [1]
        self.counts: dict[int, int] = {}

    def level(self, size: int) -> int:
        while self.tops[-1] < size:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * LEVEL)))
        return int(np.searchsorted(self.tops, size))

    def levels(self, size: int) -> set[int]:
        """A pair is met at the level of its larger set."""
        return {*range(self.level(size), self.level(size * self.den // self.num) + 1)}

    def differ(self, level: int) -> int:
        """The most shingles in which linked sets of this level can differ."""
        return 2 * self.tops[level] * (self.den - self.num) // (self.den + self.num)

    def parts(self, level: int) -> int:
        """So many parts that more than differ() of a set's are not empty, but for very rare sets."""
        if level not in self.counts:
            least = max(1, (self.tops[level - 1] if level else 0) * self.num // self.den)
            need = self.differ(level) + 1
            k = need
            while k < 4 * need and k - (e := k * math.exp(-least / k)) - 5 * math.sqrt(e) - 2 < need:
                k += 1
            self.counts[level] = k
        return self.counts[level]

    def signatures(self, found: np.ndarray, sketch: Sketch) -> np.ndarray:
        """What a set meets its partners by."""
        if self.by_prefix:
            rare = np.lexsort((found, sketch.order(found)))
            return found[rare[: len(found) + self.num * len(found) // -self.den + 1]]
        out = []
        frequent = sketch.counts[bucket(found)] > sketch.often
        for level in self.levels(len(found)):
            if not (h := self.differ(level)):
                continue  # only equal sets link, and those are one class
            k = self.parts(level)
            with np.errstate(over="ignore"):
                part = (mixed(found + np.uint64(0x51ED27)) % np.uint64(k)).astype(np.int64)
                sums = np.zeros(k, np.uint64)
                np.add.at(sums, part, mixed(found ^ np.uint64(0xA5A5A5A5)))
                sign = mixed(sums + mixed(np.arange(k, dtype=np.uint64) + np.uint64(level * 1_000_003)))
            # A part without a rare shingle tells little. If more than h parts of a set have one, a partner agrees on
            # such a part; a set with fewer also signs its other parts, as does any partner of which that is true.
            telling = np.bincount(part[~frequent], minlength=k) > 0
            out.append(sign[telling] if telling.sum() > h else sign)
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def needed(a: int, b: int, num: int, den: int) -> int:
    """The least intersection with which sets of a and b shingles link."""
    return -(-num * (a + b) // (num + den))


class Index:
    """Inverted lists of sets, searched with DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        self.lists: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            for x in s.tolist():
                self.lists.setdefault(x, []).append(k)

    def search(self, query: np.ndarray, num: int, den: int, skip) -> Iterator[int]:
        """The indexed sets that link with query; those for which skip(k) holds are passed over."""
        n = len(query)
        least = -(-num * n // den)
        if not n:
            return
        lists = sorted((x for x in map(self.lists.get, query.tolist()) if x), key=len)
        if len(lists) < least:
            return
        longest = min(least - 1, int(least / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        short, long = lists[: len(lists) - longest], lists[len(lists) - longest :]
        heap = [(x[0], j, 0) for j, x in enumerate(short)]
        heapq.heapify(heap)
        while heap:
            k, count = heap[0][0], 0
            while heap and heap[0][0] == k:
                _, j, at = heap[0]
                count += 1
                if at + 1 < len(short[j]):
                    heapq.heapreplace(heap, (short[j][at + 1], j, at + 1))
                else:
                    heapq.heappop(heap)
            if skip(k):
                continue
            ask = needed(n, self.sizes[k], num, den)
            if count + len(long) < ask:
                continue
            for j, x in enumerate(long):
                if count >= ask or count + len(long) - j < ask:
                    break
                at = bisect_left(x, k)
                count += at < len(x) and x[at] == k
            if count >= ask:
                yield k


class Groups:
    """Union-find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def block_links(sets: list[np.ndarray], n_index: int, num: int, den: int, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked among the first n_index sets and between them and the others; with labels, sets of
    one label are connected already, and only links of the others with the first n_index are looked for."""
    groups, out = Groups(len(sets)), []
    index = Index(sets[:n_index])
    if labels is not None:
        seen: dict = {}
        for k, x in enumerate(labels):
            groups.join(k, seen.setdefault(x, k))
    tops = {groups.find(k) for k in range(n_index)}  # the roots of the components that the index has

    def link(q: int, k: int) -> None:
        a, b = groups.find(q), groups.find(k)
        if a != b:
            groups.join(a, b)
            out.append((q, k))
            if a in tops or b in tops:
                tops.difference_update((a, b))
                tops.add(groups.find(q))

    for q in range(0 if labels is None else n_index, len(sets)):
        if n_index > PROBE_ABOVE:
            for t in sorted(tops)[:PROBES]:
                if t != groups.find(q) and len(np.intersect1d(sets[q], sets[t], assume_unique=True)) >= needed(len(sets[q]), len(sets[t]), num, den):
                    link(q, t)
        if tops != {groups.find(q)}:
            for k in index.search(sets[q], num, den, lambda k, q=q: groups.find(k) == groups.find(q)):
                link(q, k)
    return out


def mark_of(text: str) -> Column:
    return F.xxhash64(common.text_or_empty(text))


def set_table(docs: DataFrame, doc: str, text: str, width: int) -> DataFrame:
    """(doc_id, mark, n_shingles, key) of every document, mark being a hash of its text; and rows of each task's sketch, whose n_shingles is negative."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, ids = WordHash(), np.zeros(1 << SKETCH_BITS, np.uint32), pa.array([], pa.int64())
        names = ["doc_id", "mark", "n_shingles", "key"]
        for batch in common.batches(batches):
            found = [shingles(t, width, hashes) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            counts += np.bincount(np.concatenate([bucket(s) for s in found]), minlength=1 << SKETCH_BITS).astype(np.uint32) if found else 0
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(map(len, found), pa.int64()), pa.array(map(set_key, found), pa.binary())], names=names)
        rows = counts.reshape(-1, SKETCH_ROW)
        at = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), ids.type), pa.nulls(len(at), pa.int64()), pa.array(-1 - at), pa.array([r.tobytes() for r in rows[at]], pa.binary())], names=names)

    return docs.select(F.col(doc).alias("doc_id"), mark_of(text).alias("mark"), common.text_or_empty(text).alias("text")).mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, key binary")


def summed(rows: DataFrame) -> Sketch:
    """The sketch of all tasks: rows are summed in two steps, and the driver gets one of each."""

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(k, np.uint32).astype(np.uint32) for k in part.key)
        return pd.DataFrame({"n_shingles": part.n_shingles[:1], "key": [total.tobytes()]})

    some = rows.where("n_shingles < 0").select("n_shingles", "key", F.pmod(F.xxhash64("key"), F.lit(64)).alias("salt"))
    some = some.groupBy("n_shingles", "salt").applyInPandas(add, "n_shingles long, key binary")
    counts = np.zeros((1 << SKETCH_BITS) // SKETCH_ROW * SKETCH_ROW, np.uint32).reshape(-1, SKETCH_ROW)
    for r in some.groupBy("n_shingles").applyInPandas(add, "n_shingles long, key binary").collect():
        counts[-1 - r.n_shingles] = np.frombuffer(r.key, np.uint32)
    return Sketch(counts.ravel())


def signature_table(docs: DataFrame, text: str, width: int, num: int, den: int, sketch: Sketch) -> DataFrame:
    """(sign, id): id is the first 8 bytes of the set's key. In a batch, each signature keeps two ids, and its first is tied to its others by a signature of their own."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts = WordHash(), Parts(num, den)
        for batch in common.batches(batches):
            own: dict[int, np.ndarray] = {}
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                found = shingles(t, width, hashes)
                if len(found):
                    key = int.from_bytes(set_key(found)[:8], "big", signed=True)
                    if key not in own:
                        own[key] = parts.signatures(found, sent.value).view(np.int64)
            ids = np.repeat(np.fromiter(own, np.int64, len(own)), [len(x) for x in own.values()])
            signs = np.concatenate([*own.values(), np.empty(0, np.int64)])
            order = np.lexsort((ids, signs))
            ids, signs = ids[order], signs[order]
            new = np.concatenate([[True], signs[1:] != signs[:-1]]) if len(signs) else np.empty(0, bool)
            kept = new | np.concatenate([[False], new[:-1]])  # the row after a first one is a second, or a first itself
            first = ids[new][np.cumsum(new) - 1] if len(signs) else ids
            tied = np.unique(np.stack([ids[~new], first[~new]], 1), axis=0)
            tied = tied[tied[:, 0] != tied[:, 1]]
            with np.errstate(over="ignore"):
                tie = mixed(mixed(tied[:, 0].view(np.uint64)) + tied[:, 1].view(np.uint64)).view(np.int64) if len(tied) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([signs[kept], tie, tie])), pa.array(np.concatenate([ids[kept], *(np.ascontiguousarray(tied[:, c]) for c in (0, 1))]))], names=["sign", "id"])

    return docs.select(common.text_or_empty(text).alias("text")).mapInArrow(run, "sign long, id long")


def marked(signs: DataFrame, before: np.ndarray | None) -> np.ndarray:
    """Bits of the signatures that several ids have, and of those known before: made by Spark's bitmap functions, 2 ** SHARED_BITS bits in all.

    A set that signs with such a shingle meets sets that merely share a phrase. Put last in the order, it signs no longer,
    unless the set has too few others; any order that all sets follow finds every link.
    """
    several = signs.groupBy("sign").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    at = F.col("sign").bitwiseAND(F.lit((1 << SHARED_BITS) - 1)) + 1
    rows = several.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(1 << SHARED_BITS - 3, np.uint8) if before is None else before.copy()
    for r in rows.collect():  # rows of 4 KB
        out[(r.k - 1) * len(r.bits) : r.k * len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return out


def links(docs: DataFrame, sets: DataFrame, doc: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(a, b): pairs of keys of linked sets that connect every component."""
    sketch = summed(sets)
    for _ in range(REFINED * Parts(num, den).by_prefix):
        sketch = Sketch(sketch.counts, marked(signature_table(docs, text, width, num, den, sketch), sketch.shared))
    signs = signature_table(docs, text, width, num, den, sketch)
    tied = signs.withColumn("low", F.min("id").over(W.partitionBy("sign"))).where("id <> low")
    families = common.components(tied.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), "families")
    id64 = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")
    classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n")).withColumn("id", id64)
    members = classes.join(families, F.col("id") == F.col("node")).select("key", "doc", "n", "root")
    # Linked sets are in one range of sizes or in neighbouring ones; the ranges are a little wider than they need be.
    members = common.durable(members.withColumn("range", F.floor(F.ln("n") / math.log(den / num * 1.0001)).cast("int")), "members")
    sized = members.groupBy("root", "range").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.min("key").alias("pivot"))
    sized = common.durable(sized, "sized")
    placed = members.join(sized, ["root", "range"]).withColumn("block", F.pmod(F.xxhash64("key", "root"), F.col("blocks")).cast("int"))
    placed = common.durable(placed.select("key", "doc", "root", "range", "block", "blocks", (F.col("key") == F.col("pivot")).alias("is_pivot")), "placed")
    reps = placed.select(F.col("doc").alias(doc)).distinct()
    texts = docs.join(common.sized(reps), doc, "left_semi").select(common.text_or_empty(text).alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in common.batches(batches):
            own = {set_key(s): s for s in (shingles(t, width, hashes) for t in batch.column(0).cast(pa.binary()).to_pylist())}
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([s.tobytes() for s in own.values()], pa.binary())], names=["key", "hashes"])

    found = texts.mapInArrow(hashed, "key binary, hashes binary")
    rows = found.join(placed.drop("doc"), "key")
    several = sized.groupBy("root").agg(F.sum("blocks").alias("n")).where("n > 1").select("root")
    split = not several.isEmpty()
    if split:
        rows = common.durable(rows.drop_duplicates(["key"]), "hashes")
        # A pivot visits the other blocks of its range and those of the next one.
        to = [sized.select("root", (F.col("range") - d).alias("range"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), F.lit(d).alias("step")) for d in (0, 1)]
        ways = to[0].unionByName(to[1])
        visits = rows.where("is_pivot").join(ways, ["root", "range"]).where("step = 1 OR to <> block")
        visits = visits.select("key", "hashes", "root", (F.col("range") + F.col("step")).alias("range"), F.col("to").alias("block"), F.lit(False).alias("home"))
        home = rows.select("key", "hashes", "root", "range", "block", F.lit(True).alias("home")).unionByName(visits)
    else:
        home = rows.select("key", "hashes", "root", "range", "block", F.lit(True).alias("home"))

    def within(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("key").sort_values(["home", "key"], ascending=[False, True])
        return named(part.key.tolist(), block_links([np.frombuffer(h, np.uint64) for h in part.hashes], int(part.home.sum()), num, den))

    def between(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["second", "key"])
        return named(part.key.tolist(), block_links([np.frombuffer(h, np.uint64) for h in part.hashes], int((~part.second).sum()), num, den, part.label.tolist()))

    pairs = "a binary, b binary"
    links_in = home.groupBy("root", "range", "block").applyInPandas(within, pairs)
    if not split:
        return links_in
    links_in = common.durable(links_in, "links_in")
    labels = common.components(links_in, "labels").withColumnsRenamed({"node": "key", "root": "label"})
    labelled = rows.join(several, "root", "left_semi").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    labelled = common.durable(labelled.select("key", "hashes", "root", "range", "block", "label"), "labelled")
    blocks = common.durable(labelled.groupBy("root", "range", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")), "blocks")
    other = blocks.select("root", F.col("range").alias("range2"), F.col("block").alias("block2"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    met = [blocks.withColumn("range2", F.col("range") + d).join(other, ["root", "range2"]).where("block < block2" if d == 0 else "true") for d in (0, 1)]
    open_pairs = met[0].unionByName(met[1]).where("NOT (low = high AND low2 = high2 AND low = low2)").select("root", "range", "block", "range2", "block2")
    open_pairs = common.durable(open_pairs, "open_pairs")
    if open_pairs.isEmpty():
        return links_in
    first = open_pairs.join(labelled, ["root", "range", "block"]).withColumn("second", F.lit(False))
    second = open_pairs.join(labelled.withColumnsRenamed({"range": "range2", "block": "block2"}), ["root", "range2", "block2"]).withColumn("second", F.lit(True))
    return links_in.unionByName(first.unionByName(second).groupBy("root", "range", "block", "range2", "block2").applyInPandas(between, pairs))


def named(keys: list[bytes], found: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"a": [keys[a] for a, _ in found], "b": [keys[b] for _, b in found]})


def grouped(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, first) of every document: first is the least (id, mark) of its component, null for an empty set."""
    with common.scratch(docs.sparkSession, "jaccard"):
        sets = common.durable(set_table(docs, doc, text, width), "sets")
        linked = common.components(links(docs, sets, doc, text, width, num, den), "linked")
        classes = sets.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "mark")).alias("first"))
        classes = common.durable(classes.join(linked, F.col("key") == F.col("node"), "left").select("key", "low", "first", F.coalesce("root", "key").alias("root")), "classes")
        lows = classes.groupBy("root").agg(F.min("low").alias("component"), F.min("first").alias("least"))
        names = classes.join(lows, "root").select("key", "component", F.col("least").alias("first"))
        out = sets.where("n_shingles >= 0").join(names, "key", "left")
        return common.durable(out.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "first"), "groups", up=1)


def joined(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    return grouped(docs, doc, text, width, num, den).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame, doc: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component: that of the smallest id, of one id that of the smallest hash of its text, of rows equal in both any one.

    Rows are told apart by id and text, so rows that share an id but not their texts stand for themselves. Rows without words all stay.
    """
    own, k_doc, k_mark = common.unused(docs, "__mark", "__doc", "__gone")
    with common.scratch(docs.sparkSession, "near"):
        rows = grouped(docs, doc, text, width, num, den).where("n_shingles > 0").select(F.col("doc_id").alias(k_doc), F.col("mark").alias(k_mark), "first")
        least = F.col(k_doc).eqNullSafe(F.col("first.doc_id")) & (F.col(k_mark) == F.col("first.mark"))
        gone = common.durable(rows.where(~least).select(k_doc, k_mark).distinct(), "gone", up=1)
        again = common.durable(rows.where(least).groupBy(k_doc, k_mark).count().where("count > 1").select(k_doc, k_mark), "again", up=1)
    same = lambda a, b: a[doc].eqNullSafe(b[k_doc]) & (a[own] == b[k_mark])
    marked_ = docs.withColumn(own, mark_of(text))
    left = marked_.join(common.sized(gone), same(marked_, gone), "left_anti")
    if not again.isEmpty():
        more = common.sized(again)
        left = left.join(more, same(left, again), "left_anti").unionByName(left.join(more, same(left, again), "left_semi").dropDuplicates([doc, own]))
    return left.select([F.col(f"`{c}`") for c in docs.columns])


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return joined(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + least(3, len(w)) - 1], ' ') AS sh FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 90 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
