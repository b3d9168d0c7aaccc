"""Streaming forms: scores of arriving texts, running quality means, drift by window, replay of the last log lines."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Log lines of a job that a late reader gets.
REPLAY = 500


def drift(events: DataFrame, time: str, value: str, *groups: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of a value by tumbling window; on a stream, rows later than the watermark are left out and closed windows forgotten."""
    zoned = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need instants
    rows = zoned.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), *groups).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"))
    return out.select(F.col("w.start").alias("start"), *groups, "n", "mean")


def running_means(rows: DataFrame, *values: str) -> DataFrame:
    """Means of all rows so far, for output mode complete; nulls and NaN do not count."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return rows.agg(*[F.round(F.avg(clean(v)), 6).alias(f"mean_{v}") for v in values], *[F.count(clean(v)).alias(f"n_{v}") for v in values])


def scored(texts: DataFrame, score: Column, name: str = "score") -> DataFrame:
    """The same column expressions score a stream as a table."""
    return texts.withColumn(name, score)


def replay(log: DataFrame, job: str, order: str, keep: int = REPLAY) -> DataFrame:
    """The last lines of each job."""
    return log.withColumn("__n", F.row_number().over(W.partitionBy(job).orderBy(F.desc(order)))).where(F.col("__n") <= keep).drop("__n")


def buffered(log: DataFrame, job: str, order: str, line: str, time: str, keep: int = REPLAY, idle: str = "24 hours", late: str = "10 minutes") -> DataFrame:
    """On a stream of log lines, for output mode update: (job, seen, lines) whenever a job has new lines, with its last lines in order.

    A completion message is a line like others. A job's state is at most keep lines, whatever the order of their arrival; it is forgotten
    when the watermark passes idle after the job's last line, and its lines are then no longer sent. A null line is an empty one;
    lines without a time are left out.
    """
    rest = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        seen, newest, orders, lines = state.get if state.exists else (0, state.getCurrentWatermarkMs(), [], [])
        last = list(zip(orders, lines, strict=True))
        for b in batches:
            seen, newest = seen + len(b), max(newest, int(b.ms.max()))
            last = heapq.nlargest(keep, last + list(zip(b.k.tolist(), b.line.tolist(), strict=True)))
        last.sort()
        state.update((seen, newest, [k for k, _ in last], [x for _, x in last]))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + rest)
        yield pd.DataFrame({job: [key[0]], "seen": [seen], "lines": [[x for _, x in last]]})

    zoned = log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).where(F.col(time).isNotNull())
    rows = zoned.select(F.col(job).alias("job"), F.col(time).alias("time"), F.unix_millis(time).alias("ms"), F.col(order).cast("long").alias("k"), F.coalesce(F.col(line).cast("string"), F.lit("")).alias("line"))
    return rows.groupBy("job").applyInPandasWithState(run, f"`{job}` {dict(log.dtypes)[job]}, seen long, lines array<string>", "seen long, newest long, orders array<long>, lines array<string>", "update", "EventTimeTimeout")


def unexpired(jobs: DataFrame, time: str, now: Column, age: str = "24 hours") -> DataFrame:
    """Jobs younger than an age."""
    return jobs.where(F.col(time) >= now - F.expr(f"INTERVAL {age}"))
