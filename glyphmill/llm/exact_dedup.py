"""Operator 11: exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every task reads its rows in blocks, hashes the normalised texts (A-Z in lower case) and keeps of each hash as many bits as tell
   the rows of the table apart, and twelve more. A block's distinct fingerprints, sorted and cut by the ranges of their owners, are sent as
   Golomb-coded gaps, some fifteen bits each.
2. An owner decodes what its range got and answers each block with a bitmap: which of its fingerprints another block has as well.
3. The answers, put back in the order of rows, mark the suspects by file and row. Only the suspects' texts are shuffled; they are
   grouped by hash and by their very bytes, so that what a short fingerprint mistook for a copy is told apart again.
4. Groups of several rows give every row its keep_id and group_size; all other rows are alone.

Rows are addressed by file and row number, which hold however the files are split; a table that is not read from such files is
written once. Blocks are written before they are sent, and so is what is broadcast. Marks are broadcast in passes over the files, so
many words of 64 rows at a time. A text that a third of all rows share is sent once by each block and counted in each task before the
shuffle, and its group is broadcast to its rows.

Defined results: a null text counts as empty; ids are read as whole numbers; rows without an id rank below all others, and a
group of such rows has no keep_id; of rows that repeat an id and a text one stays, the others are dropped by it; an empty table gives an
empty result; other columns are not read by decisions(), and kept, whatever their names, by deduplicated().
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rows of a block; fingerprints that an owner is to expect; bits of a fingerprint beyond those that number the rows.
BLOCK, OWNED, SPARE_BITS = 1 << 18, 1 << 20, 12
#: Rows that a word of marks covers, as a shift.
WORD = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# Golomb coding of sorted numbers
def encoded(numbers: np.ndarray, span: int) -> bytes:
    """The gaps of sorted, different numbers below span, by Golomb's code with a power of two: quotients in unary, then the remainders' bits.

    The first byte is that power, near 0.69 of the mean gap.
    """
    gaps = np.diff(numbers, prepend=np.uint64(0))
    bits = max(0, int(0.69 * span / len(numbers)).bit_length() - 1)
    unary = np.ones(int((gaps >> np.uint64(bits)).sum()) + len(gaps), np.uint8)
    unary[np.cumsum((gaps >> np.uint64(bits)).astype(np.int64) + 1) - 1] = 0
    rest = (gaps[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return bytes([bits]) + np.packbits(unary).tobytes() + np.packbits(rest).tobytes()


def decoded(code: bytes, n: int) -> np.ndarray:
    """The n numbers of encoded()."""
    bits, size = code[0], (n * code[0] + 7) // 8
    raw = np.frombuffer(code, np.uint8, offset=1)
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - size]) == 0)[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    rest = np.unpackbits(raw[len(raw) - size :])[: n * bits].reshape(n, bits).astype(np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(bits)) + (rest << np.arange(bits, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


# Rows and their addresses
def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case, nothing else changed."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.translate(t, UPPER, LOWER)).otherwise(F.lower(t))


def addressed(docs: DataFrame, key: str, text: str, *own: str) -> DataFrame:
    """(own: a struct of the named columns, id, norm, file, row) of docs; two files of one hash make more suspects, not fewer."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("own"), F.col(f"`{key}`").cast("long").alias("id"), normalised(F.col(f"`{text}`")).alias("norm"))
    at = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return rows.select("*", *at)
    except AnalysisException:  # not a scan of files with numbered rows
        return common.durable(rows, "rows", up=1).select("*", *at)


def sent(rows: DataFrame, bits: int, owners: int) -> DataFrame:
    """(block, owner, n, code, files, rows, place): the messages of rows (file, row, hash), with the rows that each was made of.

    place is each row's place among the message's n fingerprints.
    """
    span = -(-(1 << bits) // owners)

    def message(block: int, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = table[np.argsort(table["f"], kind="stable")]
        owner = (table["f"] // np.uint64(span)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        out = []
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(table)], strict=True):
            own, place = np.unique(table["f"][a:b], return_inverse=True)
            out.append((block, int(owner[a]), len(own), encoded(own - np.uint64(int(owner[a]) * span), span), table["file"][a:b], table["row"][a:b], place))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SENT, strict=True)], names=["block", "owner", "n", "code", "files", "rows", "place"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, block = [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK):
                part = batch.slice(k, BLOCK)
                table = np.empty(part.num_rows, [("file", np.int64), ("row", np.int64), ("f", np.uint64)])
                for c, name in enumerate(("file", "row", "f")):
                    table[name] = part.column(c).to_numpy().view(np.uint64 if name == "f" else np.int64)
                table["f"] >>= np.uint64(64 - bits)
                held.append(table)
                count += len(table)
                if count >= BLOCK:
                    yield from message(block, np.concatenate(held))
                    held, count, block = [], 0, block + 1
        if count:
            yield from message(block, np.concatenate(held))

    return rows.mapInArrow(blocks, "block long, owner long, n long, code binary, files array<long>, rows array<long>, place array<int>")


_SENT = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def answered(messages: pd.DataFrame) -> pd.DataFrame:
    """(block, owner, bitmap) of an owner's messages: the fingerprints that several blocks have."""
    lists = [decoded(c, n) for c, n in zip(messages["code"], messages["n"], strict=True)]
    _, at, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    several = np.split(count[at] > 1, np.cumsum([len(x) for x in lists])[:-1])
    return pd.DataFrame({"block": messages["block"], "owner": messages["owner"], "bitmap": [np.packbits(s).tobytes() for s in several]})


def marked(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, word, bits) of messages (n, files, rows, place, bitmap): rows whose fingerprint the block itself has twice, or another one too."""
    for batch in given:
        kept = []
        n, files, rows, place, bitmaps = (batch.column(k) for k in range(5))
        for k in range(batch.num_rows):
            at = place[k].values.to_numpy()
            several = np.bincount(at, minlength=n[k].as_py()) > 1
            several |= np.unpackbits(np.frombuffer(bitmaps[k].as_py(), np.uint8))[: len(several)].astype(bool)
            suspect = several[at]
            kept.append((files[k].values.to_numpy()[suspect], rows[k].values.to_numpy()[suspect]))
        file, row = (np.concatenate(c) if kept else np.array([], np.int64) for c in (zip(*kept, strict=True) if kept else ([], [])))
        frame = pd.DataFrame({"file": file, "word": row >> WORD, "bits": np.left_shift(np.int64(1), row & ((1 << WORD) - 1))}).drop_duplicates()
        words = frame.groupby(["file", "word"], as_index=False)["bits"].agg(np.bitwise_or.reduce) if len(frame) else frame
        yield pa.RecordBatch.from_pandas(words.astype("int64"), preserve_index=False)


def suspects(hashes: DataFrame, total: int) -> DataFrame:
    """(file, word, bits): the rows of hashes (file, row, hash), by words of 64, whose fingerprint is not alone in the table."""
    bits = min(64, max(1, total.bit_length()) + SPARE_BITS)
    owners = max(4 * common.shuffle_parts(hashes.sparkSession), -(-total // OWNED))
    messages = common.durable(sent(hashes, bits, min(owners, 1 << bits)), "messages")
    answers = common.durable(messages.select("block", "owner", "n", "code").groupBy("owner").applyInPandas(answered, "block long, owner long, bitmap binary"), "answers")
    told = messages.join(common.sized(answers), ["block", "owner"]).select("n", "files", "rows", "place", "bitmap")
    return told.mapInArrow(marked, "file long, word long, bits long").groupBy("file", "word").agg(F.bit_or("bits").alias("bits"))


def groups(rows: DataFrame) -> tuple[DataFrame, int]:
    """(digest, keep_id, best, size) of the texts that several of addressed() rows have, and the number of rows.

    best ranks the rows of a group: by id, and by address where an id repeats.
    """
    total = rows.count()
    words = common.durable(suspects(rows.select("file", "row", F.xxhash64("norm").alias("hash")), total), "words")
    passes = 1 + words.count() // common.BROADCAST_ROWS
    found = None
    for k in range(passes):
        of_pass = F.pmod("file", F.lit(passes)) == k
        marks = F.broadcast(words.where(of_pass))
        # The condition on the path alone leaves the pass's files to be read only.
        some = rows.where(of_pass).withColumn("word", F.shiftright("row", WORD)).join(marks, ["file", "word"])
        some = some.where(F.getbit("bits", F.col("row").bitwiseAND((1 << WORD) - 1).cast("int")) == 1)
        own = common.durable(some.groupBy(F.xxhash64("norm").alias("hash"), "norm").agg(F.count("*").alias("size"), F.max("id").alias("id"), F.max(rank()).alias("best")).select("hash", F.unhex(F.sha2("norm", 256)).alias("digest"), "size", "id", "best"), "verified")
        found = own if found is None else found.unionByName(own)
    if passes > 1:
        # Each pass has told its texts apart by their bytes; their digests bring the passes together.
        found = found.groupBy("hash", "digest").agg(F.sum("size").alias("size"), F.max("id").alias("id"), F.max("best").alias("best"))
    return common.durable(found.where("size > 1").select("digest", F.col("id").alias("keep_id"), "best", "size"), "groups", up=1), total


def rank() -> Column:
    """A number that grows with the id, missing ones first, and differs between rows of one id."""
    tie = F.pmod(F.xxhash64("file", "row"), F.lit(10**18)).cast("decimal(19,0)")
    return (F.coalesce("id", F.lit(-(1 << 63))).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + tie).cast("decimal(38,0)")


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256, in place of such columns of its own."""
    own = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept", "text_sha256")]
    with common.scratch(docs.sparkSession, "exact_dedup"):
        rows = addressed(docs, key, text, *own)
        several, total = groups(rows.drop("own"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))
    is_hot = F.col("size") * common.HOT > total
    hot, cold = (several.where(c).select(F.struct("keep_id", "best", "size").alias(name), F.col("digest").alias(f"{name}_digest")) for name, c in (("hot", is_hot), ("cold", ~is_hot)))
    rows = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot_digest"), "left")
    # Rows of hot groups meet no other: a key of their own spreads them.
    rows = rows.withColumn("meets", F.when(F.col("hot_digest").isNull(), F.col("digest")).otherwise(F.concat("digest", F.encode(F.col("row").cast("string"), "utf-8"))))
    rows = rows.join(common.sized(cold), F.col("meets") == F.col("cold_digest"), "left").withColumn("group", F.coalesce("hot", "cold"))
    alone = F.col("group").isNull()
    return rows.select(
        "own.*",
        F.when(alone, F.col("id")).otherwise(F.col("group.keep_id")).alias("keep_id"),
        F.coalesce("group.size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (rank() == F.col("group.best"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    kept = decisions(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("norm")), "id", "norm")
    return kept.where("kept").select("all.*")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return decisions(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
