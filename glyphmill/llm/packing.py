"""Operator 2: best-fit packing of token pieces by the configuration linear program.

The lengths of all pieces make a histogram of at most CAPACITY entries, which is all the driver sees. Over
it runs the configuration program (patterns of lengths that fit a sequence; cover all pieces with as few as
possible): multiplicative weights hold a price for each length, a knapsack dynamic program over the
capacity prices patterns (for every length the best pattern with it, from one table), and patterns near the
optimum share a round's mass. The averaged solution is rounded down, and what is left is packed by best
fit: the longest piece with the completion that leaves the least room. Pieces then take their places from
their rank among those of their length, in the tasks, with no row leaving its task for another.

Defined results: null and empty texts are one piece of the closing id alone; texts of any length are cut
only where they exceed the capacity; repeated rows are packed each; an empty table gives an empty result;
columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .bpe import Kept, Vocabulary, in_bytes, public_path

CAPACITY = 2048
#: Rounds of multiplicative weights, their rate, and how near the best a pattern of a round must be.
ROUNDS, RATE, NEAR = 40, 0.5, 0.02
#: Pieces of one length that are ranked together, about; fewer where that evens the tasks: so many parts for each of them.
RANKED, PARTS = 200_000, 4

PIECE = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@cache
def encoder(path: str) -> tuple[Vocabulary, Kept]:
    """A tokenizer and its words' ids, by the library's own model, once in each worker."""
    vocabulary = Vocabulary(path)
    tokenize = vocabulary.library.model.tokenize
    return vocabulary, Kept(lambda word: packed_ids([t.id for t in tokenize(in_bytes(word))]))


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, doc: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of the ids of each text and a closing id: (doc_id, piece, start, length, ids_crc32)."""
    kind = docs.schema[doc].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, kept = encoder(path)
        last = packed_ids([end_id])
        for batch in common.batches(batches):
            rows = []
            for k, t in enumerate(batch.column(1).to_pylist()):
                if vocabulary.special and vocabulary.special.search(t):
                    ids = packed_ids(vocabulary.library.encode(t, add_special_tokens=False).ids) + last
                else:
                    ids = b"".join(map(kept.__getitem__, vocabulary.words(t))) + last
                rows += [(k, p, s // 4, len(ids[s : s + 4 * capacity]) // 4, zlib.crc32(ids[s : s + 4 * capacity])) for p, s in enumerate(range(0, len(ids), 4 * capacity))]
            at, piece, start, length, crc = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc).alias("doc_id"), common.text_or_empty(text).alias("text")).mapInArrow(run, PIECE.format(kind=kind))


def priced(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the best value of each room, and the last length it takes (-1: none)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        gain = best[c - lengths[:n]] + value[:n]
        k = int(np.argmax(gain))
        if gain[k] > best[c - 1]:
            best[c], last[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    return best, last


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """The fractional solution of the configuration program: mass by pattern ((length, times), ...)."""
    lengths = np.array(sorted(histogram))
    need = np.array([histogram[x] for x in lengths.tolist()], float)
    if not len(lengths):
        return Counter()
    price, mass = lengths / capacity, Counter()
    for _ in range(ROUNDS):
        best, last = priced(lengths, price, capacity)
        value = price + best[capacity - lengths]
        patterns: Counter = Counter()
        for k in np.flatnonzero(value >= (1 - NEAR) * best[capacity]).tolist():
            own, room = Counter({k: 1}), capacity - int(lengths[k])
            while room > 0:
                while room > 0 and last[room] < 0:
                    room -= 1
                if room > 0:
                    own[int(last[room])] += 1
                    room -= int(lengths[last[room]])
            patterns[tuple(sorted(own.items()))] += need[k]
        # The round's mass is what covers each of its lengths once at most, on average over what it covers.
        cover = np.zeros(len(lengths))
        for p, m in patterns.items():
            for k, times in p:
                cover[k] += m * times
        ratio = cover / need
        scale = (need @ lengths) / (cover @ lengths)
        for p, m in patterns.items():
            mass[p] += m * scale / ROUNDS
        price = price * np.exp(-RATE * np.clip(ratio * scale - 1, -1, 1))
        price /= max(1e-300, priced_scale(price, lengths, capacity))
    return Counter({tuple((int(lengths[k]), t) for k, t in p): m for p, m in mass.items()})


def priced_scale(price: np.ndarray, lengths: np.ndarray, capacity: int) -> float:
    """Keeps prices near a sequence's share, so that they neither vanish nor overflow."""
    return float(np.max(price * (capacity // lengths)))


def completed(first: int, stock: dict[int, int], capacity: int) -> Counter:
    """first and the completion from stock that leaves the least room: subset sums over the lengths in stock."""
    own, room = Counter({first: 1}), capacity - first
    while room > 0:
        usable = [x for x in stock if x <= room and stock[x] > own[x]]
        if not usable:
            break
        steps, reach, mask = [], 1, (1 << (room + 1)) - 1
        for x in sorted(usable, reverse=True):
            before = reach
            reach |= (reach << x) & mask
            steps.append((x, before))
            if reach >> room & 1:
                break
        top = reach.bit_length() - 1
        if not top:
            break
        for x, before in reversed(steps):
            if not before >> top & 1:
                own[x] += 1
                room -= x
                top -= x
    return own


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """Patterns and how many sequences take each; together they hold the histogram exactly."""
    stock = {x: n for x, n in histogram.items() if n}
    out: list[tuple[Counter, int]] = []

    def take(pattern: Counter, times: int) -> None:
        out.append((pattern, times))
        for x, n in pattern.items():
            stock[x] -= n * times
            if not stock[x]:
                del stock[x]

    if stock.get(capacity):
        take(Counter({capacity: 1}), stock[capacity])
    full = configurations(dict(stock), capacity)
    for pattern, m in sorted(full.items(), key=lambda x: (-sum(a * b for a, b in x[0]), -x[1], x[0])):
        times = min(int(m), *(stock.get(x, 0) // n for x, n in pattern))
        if times > 0:
            take(Counter(dict(pattern)), times)
    while stock:
        pattern = completed(max(stock), stock, capacity)
        take(pattern, min(stock[x] // n for x, n in pattern.items()))
    return out


def slots(patterns: list[tuple[Counter, int]]) -> dict[str, np.ndarray]:
    """By length and rank: the first rank of each run of places, the places of one sequence in it, its first sequence and offset."""
    rows, first, rank = [], 0, Counter()
    for pattern, times in patterns:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            rows.append((x, rank[x], n, first, offset))
            rank[x] += n * times
            offset += x * n
        first += times
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...; written, as they are read twice) with sequence_id and offset."""
    spark = pieces.sparkSession
    part, rank_in = common.unused(pieces, "__part", "__rank")
    histogram = {int(r.length): r["count"] for r in pieces.groupBy("length").count().collect()}  # a row for each of capacity lengths
    share = max(1, sum(histogram.values()) // (PARTS * common.shuffle_parts(spark)))
    own = spark.createDataFrame([(x, -(-n // min(RANKED, share))) for x, n in histogram.items()] or [(0, 1)], "length long, __parts long")
    dealt = pieces.join(F.broadcast(own), "length").select(*pieces.columns, F.pmod(F.xxhash64(*pieces.columns), "__parts").cast("int").alias(part))
    # A row for each length and part of it, which are some PARTS a task or one for RANKED pieces: where the part's ranks begin.
    counts = dealt.groupBy("length", part).count().toPandas().sort_values(["length", part])
    code = (counts["length"].to_numpy(np.int64) << 32) | counts[part].to_numpy(np.int64)
    base = (counts.groupby("length")["count"].cumsum() - counts["count"]).to_numpy(np.int64)
    table = slots(plan(histogram, capacity))
    sent = spark.sparkContext.broadcast((code, base, table, (table["length"] << 44) | table["rank"]))
    ranked = dealt.withColumn(rank_in, F.row_number().over(W.partitionBy("length", part).orderBy(*pieces.columns)) - 1)
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, base, place, keys = sent.value
        for batch in batches:
            number = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
            length = number("length")
            rank = number(rank_in) + base[np.searchsorted(code, (length << 32) | number(part))]
            k = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            within, each = rank - place["rank"][k], place["each"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(place["sequence"][k] + within // each), pa.array(place["offset"][k] + within % each * length)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(common.durable(token_pieces(docs, public_path("word_bpe_49k.json")), "pieces"))
