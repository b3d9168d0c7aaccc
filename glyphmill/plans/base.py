"""Registry of queries, and the relations on the driver's tables that they start from."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with its DuckDB SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core up to which a table of few files is dealt out anew.
SMALL = 64_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, and small for so many, dealt out over the cores: one file is one task where it has one row group."""
    context = df.sparkSession.sparkContext
    cores, files = context.defaultParallelism, df.inputFiles()
    if len(files) >= cores:
        return df
    path, configuration = context._jvm.org.apache.hadoop.fs.Path, context._jsc.hadoopConfiguration()
    size = sum(path(f).getFileSystem(configuration).getFileStatus(path(f)).getLen() for f in files)
    return df.repartition(cores) if size <= SMALL * cores else df


def written(spark: SparkSession, name: str) -> str:
    """A path for files that a query writes and reads: in the shared folder where the cluster names one, on this machine if all runs here."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/glyphmill-written"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a probability made of their id, length and label: (id, text, lang, source, model, y, prob)."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    h = ((F.col("doc_id") * 7919 + F.col("n_chars") * 104729) % 1000) / 1000.0
    model = F.when(F.col("toxic") == 1, "human").otherwise(F.concat(F.lit("m"), (F.col("doc_id") % 4).cast("string")))
    return d.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "lang", "source", model.alias("model"), F.col("quality").alias("y"), (h * 0.6 + F.col("quality") * 0.4).alias("prob"))


SCORED = """scored AS (SELECT d.doc_id AS id, d.text, d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'human' ELSE 'm' || CAST(d.doc_id % 4 AS VARCHAR) END AS model, l.quality AS y,
((d.doc_id * 7919 + d.n_chars * 104729) % 1000) / CAST(1000 AS DOUBLE) * CAST(0.6 AS DOUBLE) + l.quality * CAST(0.4 AS DOUBLE) AS prob FROM documents d JOIN labels l USING (doc_id))"""

RATES = "round(CASE WHEN tp + fp + tn + fn > 0 THEN (tp + tn) / (tp + fp + tn + fn) ELSE 0 END, 6) AS acc, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1"


def counts(threshold: str = "0.5") -> str:
    """SQL of the confusion counts at a threshold."""
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN prob {op} {threshold} AND y = {y} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for n, op, y in (("tp", ">=", 1), ("fp", ">=", 0), ("tn", "<", 0), ("fn", "<", 1)))


def uniform_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(sha1(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"
