"""A session with the settings this library expects where the cluster has not set its own."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "glyphmill", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, Arrow, UTC; every setting can be overridden."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once a context."""
    if getattr(spark.sparkContext, "_glyphmill_sent", None) is None:
        package = Path(__file__).resolve().parent
        to = tempfile.mkdtemp(prefix="glyphmill-py-")
        spark.sparkContext.addPyFile(shutil.make_archive(f"{to}/{package.name}", "zip", package.parent, package.name))
        spark.sparkContext._glyphmill_sent = True


#: Spark's setting by which a query's shuffle files go when it ends; without it they stay until the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """DataFrames made and written inside are run once: their shuffle files go as each query ends."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)
