"""Statistics of the tokens that a model is made of, in whole numbers: no token is a row of a shuffle.

Texts are cut into chunks, whose words have codes; the words alone meet by name, to be counted and numbered, the most frequent first, so that
a number tells the count by the spectrum (the different counts, some square root of all tokens). A chunk sends its different pairs, as packed
numbers, to the owners of their histories; an owner has all pairs of a history, and answers each chunk in the order of its question with counts
and ranks, and what a history has once for each history. What a document needs is then in one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text
from .language_model import ALPHA, MIX, SECOND_MIX, START, _kept, history_ranks, moments, numbered

#: Tokens of a chunk, and of the texts for each owner.
CHUNK, OWNED = 1_000_000, 4_000_000
MOMENTS = ("entropy", "variance", "cross", "best")


def packed(*arrays: np.ndarray) -> dict:
    """Arrays as one binary, compressed with the bytes of each place together, and its size."""
    raw = b"".join(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in map(np.ascontiguousarray, arrays))
    return {"data": pa.compress(raw, "zstd", asbytes=True), "size": len(raw)}


def unpacked(data: bytes, size: int, *kinds: tuple[str, int]) -> list[np.ndarray]:
    """The arrays of packed(), of these types and lengths."""
    raw, out, at = np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True), np.uint8), [], 0
    for kind, n in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def chunks(docs: DataFrame, key: str, column: str, folder: str) -> DataFrame:
    """(chunk, keys, sizes, codes, words, counts): the texts that have words, as codes of the chunk's own words."""

    def made(number: int, keys: list, lists: list) -> pa.RecordBatch:
        lists = pa.concat_arrays(lists)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int32)
        whole = {"chunk": number, "keys": pa.concat_arrays(keys).to_pylist(), "sizes": lists.value_lengths().to_pylist(), **packed(codes), "words": coded.dictionary.to_pylist(), "counts": np.bincount(codes).tolist()}
        return pa.RecordBatch.from_pylist([whole], schema)

    def run(batches):
        k, held = 0, ([], [], 0)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                held = (held[0] + [part.column(0)], held[1] + [part.column(1)], held[2] + len(part.column(1).flatten()))
                if held[2] >= CHUNK:
                    yield made((TaskContext.get().partitionId() << 20) + k, *held[:2])
                    k, held = k + 1, ([], [], 0)
        if held[2]:
            yield made((TaskContext.get().partitionId() << 20) + k, *held[:2])

    kind = docs.schema[key].dataType
    own = docs.select(key, F.transform(text.split_words(F.col(column)), F.lower).alias("w")).where(F.size("w") > 0)
    ddl = f"chunk long, keys array<{kind.simpleString()}>, sizes array<int>, data binary, size long, words array<string>, counts array<long>"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return _kept(own.mapInArrow(run, ddl), folder, "chunks")


class Spectrum:
    """The different counts of tokens, the largest first, and the first number of each; and the sums over all tokens that moments need."""

    def __init__(self, words: DataFrame, mix: float, second: float, alpha: float):
        rows = words.groupBy("n").count().toPandas().sort_values("n", ascending=False)
        self.counts, many = rows["n"].to_numpy(np.int64), rows["count"].to_numpy(np.int64)
        self.first, self.words = np.append(0, np.cumsum(many)[:-1]), int(many.sum())
        n = int((self.counts * many).sum())
        self.tokens, self.mix, self.second = n, mix, second
        self.q = (self.counts + alpha) / (n + alpha * max(self.words, 1)) if n else np.empty(0)
        b1, b2 = (1 - mix) * self.q, (1 - second) * self.q
        l1 = np.log(b1)
        self.whole = {"e0": float(many @ (b1 * l1)), "s0": float(many @ (b1 * l1 * l1)), "x0": float(many @ (b1 * np.log(b2))), "top_q": float(self.q[0]) if n else 0.0}
        self.values, self.above = b1[::-1], np.append(np.cumsum(many)[::-1], 0)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The unigram part q of words by number."""
        return self.q[np.searchsorted(self.first, numbers, side="right") - 1]


def pairs_of(ids: np.ndarray, sizes: np.ndarray, start: int, owners: int) -> tuple:
    """A chunk's different pairs (h, t), by owner, h and t, their counts, where each owner's begin, and each token's pair."""
    h = np.empty(len(ids), np.int64)
    h[1:] = ids[:-1]
    h[np.append(0, np.cumsum(sizes)[:-1])] = start
    own, which, count = np.unique((h % owners << 54) + (h // owners << 32) + ids, return_inverse=True, return_counts=True)
    o = own >> 54
    return (own >> 32 & (1 << 22) - 1) * owners + o, own & 0xFFFFFFFF, count, np.searchsorted(o, np.arange(owners + 1)), which


def starts_of(h: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return np.flatnonzero(new)


def documents(docs: DataFrame, key: str, folder: str, columns: tuple[str, ...], column: str = "text", mix: float = MIX, second: float = SECOND_MIX, alpha: float = ALPHA) -> DataFrame:
    """(key, and an array for each of columns: lp, lp2, entropy, variance, cross, best, rank): the statistics of a text's tokens, in order, under the
    model of all of them. A row for each text that has tokens; rows that repeat a key are one, put together by a shuffle where there are any."""
    kind = docs.schema[key].dataType.simpleString()
    cut = chunks(docs, key, column, folder)
    named = cut.select("chunk", F.inline(F.arrays_zip("words", "counts", F.sequence(F.lit(0), F.size("words") - 1).alias("code")))).toDF("chunk", "t", "n", "code")
    words = numbered(named.groupBy("t").agg(F.sum("n").alias("n")), folder, (F.desc("n"), "t"), "n")
    spectrum = Spectrum(words, mix, second, alpha)
    found = words.where(F.col("t") == START).first()
    start = found.id if found else spectrum.words
    owners = min(max(2 * docs.sparkSession.sparkContext.defaultParallelism, int(spectrum.tokens // OWNED), spectrum.words >> 21), 500)
    sent = docs.sparkSession.sparkContext.broadcast(spectrum)
    asked_moments = [m for m in MOMENTS if m in columns]
    ranked = "rank" in columns

    def number(own: pa.Table, ids: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        (codes,) = unpacked(row["data"], row["size"], ("i4", row["size"] // 4))
        at = np.empty(ids.num_rows, np.int32)
        at[ids["code"].to_numpy()] = ids["id"].to_numpy()
        return pa.Table.from_pylist([{k: row[k] for k in ("chunk", "keys", "sizes")} | packed(at[codes])], own.schema)

    bare = cut.select("chunk", "keys", "sizes", "data", "size")
    numbers = named.select("chunk", "code", "t").join(words.select("t", "id"), "t").select("chunk", "code", "id")
    coded = _kept(bare.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInArrow(number, bare.schema), folder, "coded")

    def opened(row: dict) -> tuple:
        (ids,) = unpacked(row["data"], row["size"], ("i4", row["size"] // 4))
        return pairs_of(ids, np.array(row["sizes"]), start, owners)

    def ask(batches):
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                h, t, count, at, _ = opened(row)
                h, t, count = h.astype(np.int32), t.astype(np.int32), count.astype(np.int32)
                rows = [{"owner": o, "chunk": row["chunk"]} | packed(h[i:j], t[i:j], count[i:j]) for o, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("data", pa.binary()), ("size", pa.int64())]))

    def answer(asked: pa.Table) -> pa.Table:
        spectrum, rows = sent.value, asked.to_pylist()
        sizes = [r["size"] // 12 for r in rows]
        parts = [unpacked(r.pop("data"), r["size"], *[("i4", n)] * 3) for r, n in zip(rows, sizes, strict=True)]
        h, t, c = (np.concatenate([p[k] for p in parts]) for k in range(3))
        whole, where = np.unique(h.astype(np.int64) << 32 | t, return_inverse=True)
        c = np.bincount(where, c).astype(np.int64)
        h, q = whole >> 32, spectrum.of(whole & 0xFFFFFFFF)
        starts = starts_of(h)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        p, _, ch, told = moments(c, q, starts, group, spectrum.whole, spectrum.mix, spectrum.second)
        rank = history_ranks(p, (1 - spectrum.mix) * q, starts, group, spectrum.values, spectrum.above).astype(np.int32) if ranked else None
        out, at = [], 0
        for r, part, n in zip(rows, parts, sizes, strict=True):
            own = where[at : at + n]
            of = group[own[starts_of(part[0])]]
            out.append({"chunk": r["chunk"], "owner": r["owner"]} | packed(c[own].astype(np.int32), *([rank[own]] if ranked else []), ch[of], *[told[m][of] for m in asked_moments]))
            at += n
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("data", pa.binary()), ("size", pa.int64())]))

    def told(own: pa.Table, answers: pa.Table) -> pa.Table:
        spectrum, row = sent.value, own.to_pylist()[0]
        h, t, _, at, which = opened(row)
        heads = starts_of(h)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h))))
        first = np.searchsorted(heads, at)  # the histories of each owner
        c, ch = np.empty(len(h), np.int32), np.empty(len(heads), np.int64)
        of = {m: np.empty(len(heads)) for m in asked_moments} | ({"rank": np.empty(len(h), np.int32)} if ranked else {})
        for r in answers.to_pylist():
            i, j, m, n = at[r["owner"]], at[r["owner"] + 1], first[r["owner"]], first[r["owner"] + 1]
            got = iter(unpacked(r["data"], r["size"], ("i4", j - i), *([("i4", j - i)] if ranked else []), ("i8", n - m), *[("f8", n - m)] * len(asked_moments)))
            c[i:j] = next(got)
            if ranked:
                of["rank"][i:j] = next(got)
            ch[m:n] = next(got)
            for name in asked_moments:
                of[name][m:n] = next(got)
        q = spectrum.of(t)
        share = lambda x: np.log(x * c / ch[group] + (1 - x) * q)
        made = {"lp": lambda: share(spectrum.mix), "lp2": lambda: share(spectrum.second), "rank": lambda: of["rank"], "best": lambda: np.log(of["best"])[group]}
        offsets = pa.array(np.append(0, np.cumsum(row["sizes"])).astype(np.int32))
        arrays = [pa.ListArray.from_arrays(offsets, pa.array((made[k]() if k in made else of[k][group])[which])) for k in columns]
        return pa.table([own["keys"].combine_chunks().flatten(), *arrays], [key, *columns])

    asks = coded.mapInArrow(ask, "owner int, chunk long, data binary, size long")
    answers = asks.groupBy("owner").applyInArrow(answer, "chunk long, owner int, data binary, size long")
    result = ", ".join([f"`{key}` {kind}", *[f"{k} array<{'int' if k == 'rank' else 'double'}>" for k in columns]])
    rows = coded.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(told, result)
    if docs.groupBy(key).count().where("count > 1").isEmpty():
        return rows
    return rows.groupBy(key).agg(*[F.flatten(F.collect_list(k)).alias(k) for k in columns])


def tokens(rows: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, pos, and a value for each of columns) of documents()."""
    return rows.select(key, F.posexplode(F.arrays_zip(*columns))).select(key, "pos", "col.*")
