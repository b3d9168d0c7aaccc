"""Helpers that the training-data operators share: durable tables, size-checked semi-joins, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, tidy

#: A key list of at most this many rows may be broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: A key is hot if it holds more than one in so many rows of its table; so many keys are hot at most, which may be broadcast.
HOT = 10_000
#: Rows that a worker turns into Python objects at once: whole texts of up to some 100 kB each must fit. Spark bounds the bytes of a batch.
BATCH_ROWS = 1_000

#: Folders of sessions on one machine that name none, by application.
_own: dict[str, str] = {}
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most BATCH_ROWS."""
    for batch in given:
        for k in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(k, BATCH_ROWS)


def unused(df: DataFrame, *names: str) -> list[str]:
    """names, each with underscores at its end until no column of df has it."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        own.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='glyphmill-')}"
        found = _own[app]
    return found.rstrip("/")


def durable(df: DataFrame, name: str, up: int = 0) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: the lineage ends here and a lost executor loses nothing.

    It goes with the innermost scratch() around, or lives on beyond so many (up) of them.
    """
    spark = df.sparkSession
    scopes = _scopes.get()
    path = "/".join([shared_dir(spark), *scopes[: len(scopes) - min(up, len(scopes))], f"{name}-{uuid.uuid4().hex}"])
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's type."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(df: DataFrame) -> None:
    """Deletes the files of a durable table that no result needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str):
    """Durable tables written inside are in a folder of their own, which is removed at the end. Results that outlive it ask for up=1.

    Shuffle files of what runs inside go with each query, so no lazy DataFrame made inside may be run again outside.
    """
    scopes = _scopes.get()
    token = _scopes.set((*scopes, f"{name}-{uuid.uuid4().hex}"))
    try:
        with tidy(spark):
            yield
    finally:
        fs, at = filesystem(spark, "/".join([shared_dir(spark), *_scopes.get()]))
        _scopes.reset(token)
        fs.delete(at, True)


def sized(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """keys with a broadcast hint if it has few enough rows (counted unless given); else as it is, for a shuffled join."""
    return F.broadcast(keys) if (keys.count() if rows is None else rows) <= BROADCAST_ROWS else keys.hint("merge")


def joined_hot(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined on keys (not null) with keyed, which has a row for each key and in __n the number of rows that have it, of total.

    Hot keys, HOT at most, are broadcast, so that the rows of one key never meet in one task; the others are joined by size.
    """
    hot = keyed.where(F.col("__n") * HOT > total).drop("__n")
    cold = keyed.where(F.col("__n") * HOT <= total).drop("__n")
    if hot.isEmpty():
        return rows.join(sized(cold), on)
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(few, on).unionByName(rest.join(sized(cold), on))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its connected component.

    Alternates large-star and small-star steps (each a group-by with map-side minimum and a join on the
    node) until no edge changes. Every round is written to the shared folder; the driver sees two sums.
    """
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    state = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        last = state
        pairs = state.select(F.explode(both).alias("e")).select("e.a", "e.b")
        low = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = pairs.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        state = durable(small, name)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == now[2] and state.join(state.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            remove(last)
            break
        remove(last)
        before = now
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
