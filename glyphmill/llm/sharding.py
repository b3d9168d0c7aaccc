"""Operator 6: sharding by size-tiered compaction.

Arrivals are appended as small immutable Parquet shards. Shards are put in tiers by size, a tier for each
power of FAN; when a tier holds FAN shards, they are merged into shards of up to the target size. Every append
and every compaction ends with a new version of the manifest, the list of live shards, which is put
in place by one rename, which fails if the version exists; it is refused if a shard of it is missing. Readers see whole
versions only. An append that loses the race for a version commits its shards to the next one; a merge does so if
the shards that it replaces are still live. Shards that neither this nor the previous version names, but an older one
does, are removed after a merge; a folder that no manifest names may be another writer's and stays until it is LEASE old.

Merging reads a tier with partitions of up to the target size (Spark packs whole small files into
each) and writes each as one shard, so that no row is shuffled.

Defined results: null columns, empty texts and repeated rows are stored as they are; columns of documents with any
name are kept; an empty arrival appends nothing, and an empty table has a manifest without shards; rows without an id,
and rows that repeat one, belong to one arrival.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a finished shard; sizes of the tiers grow by FAN from SMALL.
TARGET_BYTES, SMALL_BYTES, FAN = 128_000_000, 1_000_000, 4
ARRIVALS = 4
#: Seconds after which a folder that no manifest names belongs to a writer that has died.
LEASE = 86_400
#: Attempts to commit against other writers.
ATTEMPTS = 20


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int
    tier: int


def shard_name(path: Column) -> Column:
    """The last folder and the file of a path."""
    return F.substring_index(path, "/", -2)


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class ShardSet:
    """A versioned set of shards under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, small: int = SMALL_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.small, self.fan = spark, root.rstrip("/"), target, small, fan
        self.fs, _ = common.filesystem(spark, root)
        self.cleaned = 0  # versions up to here have no shards left of their own

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def version(self) -> int:
        """The newest version, 0 before the first."""
        at = self._path("manifest")
        if not self.fs.exists(at):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self.fs.open(self._path(f"manifest/v{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**s) for s in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Puts version base + 1 in place, or raises Conflict and changes nothing; shards that version base does not have must exist."""
        known = {s.path for s in self.shards(base)}
        for path in {s.path for s in shards} - known:
            if not self.fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path)):
                raise FileNotFoundError(path)
        to = self._path(f"manifest/v{base + 1:012d}.json")
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            stream.close()
        if self.fs.exists(to) or not self.fs.rename(draft, to):
            self.fs.delete(draft, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def replace(self, gone: list[Shard], new: list[Shard]) -> int | None:
        """Commits the newest version without the shards gone and with new ones, as often as other writers come first; None if one of gone is gone."""
        for _ in range(ATTEMPTS):
            base = self.version()
            live = self.shards(base)
            if not set(gone) <= set(live):
                return None
            try:
                return self.commit(base, [*(s for s in live if s not in set(gone)), *new])
            except Conflict:
                continue
        raise Conflict(f"lost the race for a version {ATTEMPTS} times")

    def tier(self, size: int) -> int:
        return max(0, int(math.log(max(size, 1) / self.small, self.fan)) + (size >= self.small)) if size >= self.small else 0

    def _written(self, df: DataFrame, by: str | None = None) -> dict[int, list[Shard]]:
        """The shards that a write of df makes, by the value of a column (0 without one), which is not written."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.root}/{folder}")
        parts = [s.getPath() for s in self.fs.listStatus(self._path(folder)) if s.isDirectory() and "=" in s.getPath().getName()] if by else [self._path(folder)]
        files = {s.getPath().toString(): (int(at.getName().rsplit("=", 1)[1]) if by else 0, s.getLen()) for at in parts for s in self.fs.listStatus(at) if s.getPath().getName().endswith(".parquet")}
        out: dict[int, list[Shard]] = defaultdict(list)
        if files:
            schema = df.drop(by).schema if by else df.schema
            rows = self.spark.read.schema(schema).parquet(*files).groupBy(shard_name(F.col("_metadata.file_path")).alias("f")).count()
            count = {r.f: r["count"] for r in rows.collect()}  # a row for each file
            for path, (part, size) in sorted(files.items()):
                if n := count.get("/".join(path.rsplit("/", 2)[-2:])):
                    out[part].append(Shard(path, size, n, self.tier(size)))
        return out

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as small shards."""
        return self.add(self._written(df).get(0, []))

    def add(self, shards: list[Shard]) -> int:
        """Adds shards that have been written."""
        return self.replace([], shards)

    def compact(self) -> int:
        """Merges every tier that is full, the smallest first, each once; finished shards stay as they are."""
        done: set[int] = set()
        while True:
            base = self.version()
            tiers: dict[int, list[Shard]] = defaultdict(list)
            for s in self.shards(base):
                if s.bytes < self.target / 2:
                    tiers[s.tier].append(s)
            full = min((t for t, own in tiers.items() if len(own) >= self.fan and t not in done), default=None)
            if full is None:
                return base
            done.add(full)
            new = self._merged(tiers[full])
            # Nothing is gained where every shard came out alone; nothing is valid where another writer has merged the same.
            if len(new) >= len(tiers[full]) or self.replace(tiers[full], new) is None:
                self._drop({s.path.rsplit("/", 1)[0] for s in new})
            else:
                self.clean()

    def _drop(self, folders: set[str]) -> None:
        for path in folders:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _merged(self, shards: list[Shard]) -> list[Shard]:
        """The rows of shards, written with whole small files read together up to the target size, each such part a shard."""
        conf = {"spark.sql.files.maxPartitionBytes": str(self.target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
        before = {k: self.spark.conf.get(k, None) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            return self._written(self.spark.read.parquet(*[s.path for s in shards])).get(0, [])
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def clean(self) -> None:
        """Removes shards that only versions before the previous one name, and folders that no version has named for LEASE seconds. Manifests
        stay, as a missing one could be written again by a writer that is late."""
        now = self.version()
        kept = {s.path for v in (now, now - 1) if v > 0 for s in self.shards(v)}
        old = {s.path for v in range(self.cleaned + 1, now - 1) for s in self.shards(v)}
        self._drop(old - kept)
        self.cleaned = max(self.cleaned, now - 2)
        used = {p.rsplit("/data/", 1)[1].split("/")[0] for p in kept}
        for s in self.fs.listStatus(self._path("data")):
            if s.getPath().getName() not in used and s.getModificationTime() < (time.time() - LEASE) * 1000:
                self.fs.delete(s.getPath(), True)

    def read(self) -> DataFrame | None:
        paths = [s.path for s in self.shards()]
        return self.spark.read.parquet(*paths) if paths else None


def sharded(docs: DataFrame, root: str, doc: str = "doc_id", arrivals: int = ARRIVALS, **sizes: int) -> ShardSet:
    """Appends docs in so many arrivals, by hashed id, and compacts after each. One pass over docs writes the small shards of all arrivals."""
    out = ShardSet(docs.sparkSession, root, **sizes)
    (arrival,) = common.unused(docs, "arrival")
    made = out._written(docs.withColumn(arrival, F.pmod(F.xxhash64(doc), F.lit(arrivals)).cast("int")), arrival)
    for k in range(arrivals):
        out.add(made.get(k, []))
        out.compact()
    return out


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    made = sharded(docs, f"{common.shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    version, shards = made.version(), made.shards()
    told = spark.createDataFrame([("/".join(s.path.rsplit("/", 2)[-2:]), s.bytes, s.rows, s.tier) for s in shards], "shard string, shard_bytes long, shard_rows long, tier int")
    stored = made.read()
    if stored is None:
        return told.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_chars"), F.lit("").alias("text_sha256"), "shard", "shard_bytes", "shard_rows", "tier", F.lit(version).alias("version")).limit(0)
    rows = stored.select("doc_id", F.char_length(common.text_or_empty("text")).cast("long").alias("n_chars"), F.sha2(common.text_or_empty("text"), 256).alias("text_sha256"), shard_name(F.col("_metadata.file_path")).alias("shard"))
    return rows.join(common.sized(told, len(shards)), "shard").withColumn("version", F.lit(version))
