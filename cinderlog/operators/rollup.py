"""Additive counters by second and by minute: built, merged, checked, repaired and pruned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.buckets import at, minute_of, second_of

KEYS = ("bucket", "service", "level")


def by_second(logs: DataFrame) -> DataFrame:
    return logs.groupBy(second_of(F.col("timestamp")).alias("bucket"), "service", "level").agg(F.count("*").alias("count"))


def fold(counters: DataFrame) -> DataFrame:
    """Seconds to minutes."""
    return counters.groupBy(minute_of(F.col("bucket")).alias("bucket"), "service", "level").agg(F.sum("count").cast("long").alias("count"))


def by_minute(logs: DataFrame) -> DataFrame:
    return fold(by_second(logs))


def merge(*deltas: DataFrame) -> DataFrame:
    """Delta rows of any number of batches, summed; also the compaction of many small files."""
    whole = deltas[0]
    for d in deltas[1:]:
        whole = whole.unionByName(d)
    return whole.groupBy(*KEYS).agg(F.sum("count").cast("long").alias("count"))


def reconcile(counters: DataFrame, logs: DataFrame, start: int, end: int, grain: str = "minute") -> DataFrame:
    """Counters with the buckets of the whole minutes in [start, end) counted anew from logs."""
    width = 60_000_000
    lo, hi = at(start - start % width), at(end - end % width)
    build = by_second if grain == "second" else by_minute
    outside = counters.where((F.col("bucket") < lo) | (F.col("bucket") >= hi))
    return outside.unionByName(build(logs.where((F.col("timestamp") >= lo) & (F.col("timestamp") < hi))))


def bucket_drift(counters: DataFrame, logs: DataFrame, grain: str = "minute") -> DataFrame:
    """Buckets whose counters differ from the logs, with both counts."""
    build = by_second if grain == "second" else by_minute
    have = merge(counters).withColumnRenamed("count", "stored")
    true = build(logs).withColumnRenamed("count", "actual")
    both = have.join(true, list(KEYS), "full").select(*KEYS, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return both.where("stored <> actual")


def net_drift(counters: DataFrame, logs: DataFrame) -> DataFrame:
    """One row: rows of the logs less the sum of counters."""
    total = logs.agg(F.count("*").alias("n"))
    kept = counters.agg((-F.coalesce(F.sum("count"), F.lit(0))).cast("long").alias("n"))
    return total.unionByName(kept).agg(F.sum("n").alias("drift"))


def keep_days(table: DataFrame, column: str, today: int, days: int) -> DataFrame:
    """Rows not older than so many days before today (microseconds); one rule for logs and counters alike."""
    if days < 1:
        raise ValueError("retention must be at least one day")
    midnight = today - today % 86_400_000_000
    return table.where(F.col(column) >= at(midnight - days * 86_400_000_000))


def second_cutoff(now: int, minutes: int, before: int = -(2**62)) -> int:
    """From when seconds are kept: whole minutes, and never earlier than it was before."""
    cut = now - minutes * 60_000_000
    return max(before, cut - cut % 60_000_000)
