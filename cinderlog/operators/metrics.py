"""Operational figures and the dashboard's series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.functions.buckets import at
from cinderlog.functions.percentiles import ring_percentile
from cinderlog.model import MINUTE

RING = 1000


def latest(samples: DataFrame, order: str, n: int = RING) -> DataFrame:
    """The last n samples by their order."""
    return samples.orderBy(F.desc(order)).limit(n)


def ring_summary(samples: DataFrame, value: str, order: str, n: int = RING) -> DataFrame:
    """p50, p95 and p99 of the last n samples."""
    ring = latest(samples, order, n).agg(F.collect_list(value).alias("ring"))
    return ring.select(*(ring_percentile(F.col("ring"), p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)))


def snapshot(batches: DataFrame, uptime_seconds: Column) -> DataFrame:
    """Counters of ingest batches (accepted, rejected, failed) and the mean rate."""
    return batches.agg(
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum("rejected"), F.lit(0)).alias("rejected"),
        F.count_if(F.col("failed")).alias("failures"),
        F.round(F.coalesce(F.sum("accepted"), F.lit(0)) / F.greatest(uptime_seconds, F.lit(1))).cast("long").alias("rate"),
    )


#: Kinds of requests, with the names of their part of the document.
KINDS = {"ingest": "ingestion", "query": "queries", "aggregate": "aggregations"}


def document(served: DataFrame, uptime_seconds: float, memory: dict[str, float] | None = None, ring: int = RING) -> DataFrame:
    """One row, the metrics document, from served requests (number, kind, millis, accepted, rejected, failed, from_rollup).

    Latencies are those of the last `ring` requests of a kind; failed ingests count as errors only. memory holds
    heap_used_mb and rss_mb of the process, where they are known.
    """
    ok = ~F.col("failed")
    is_ = {kind: F.col("kind") == kind for kind in KINDS}
    counts = served.agg(
        *(F.count_if(is_[k] & ok).alias(k) for k in KINDS),
        F.coalesce(F.sum(F.when(is_["ingest"] & ok, F.col("accepted"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(is_["ingest"] & ok, F.col("rejected"))), F.lit(0)).alias("rejected"),
        F.count_if(is_["ingest"] & ~ok).alias("errors"),
        F.count_if(is_["aggregate"] & ok & F.col("from_rollup")).alias("rollup"),
        F.count_if(is_["aggregate"] & ok & ~F.col("from_rollup")).alias("raw"),
    )
    for kind in KINDS:
        times = ring_summary(served.where(is_[kind] & ok), "millis", "number", ring)
        counts = counts.withColumn(f"{kind}_ms", times.select(F.struct("p50", "p95", "p99")).scalar())
    rate = F.when(F.lit(uptime_seconds) > 0, F.round(F.col("accepted") / F.lit(float(uptime_seconds) or 1.0)).cast("long")).otherwise(F.lit(0).cast("long"))
    mb = lambda name: F.round(F.lit((memory or {}).get(name)).cast("double"), 1).alias(name)
    return counts.select(
        F.round(F.lit(float(uptime_seconds))).cast("long").alias("uptime_seconds"),
        F.struct(
            F.col("ingest").alias("requests"), F.col("accepted").alias("logs_accepted"), F.col("rejected").alias("logs_rejected"), "errors",
            rate.alias("logs_per_second"), F.col("ingest_ms").alias("latency_ms"),
        ).alias("ingestion"),
        F.struct(F.col("query").alias("requests"), F.col("query_ms").alias("latency_ms")).alias("queries"),
        F.struct(F.col("aggregate").alias("requests"), F.col("rollup").alias("served_from_rollup"), F.col("raw").alias("served_from_raw"), F.col("aggregate_ms").alias("latency_ms")).alias("aggregations"),
        F.struct(mb("heap_used_mb"), mb("rss_mb")).alias("memory"),
    )


def minute_series(counts: DataFrame, end: int, points: int = 60) -> DataFrame:
    """points minutes up to end (exclusive), with 0 where counts (bucket_start, cnt) has none."""
    last = end - end % MINUTE
    spark = counts.sparkSession
    series = spark.range(points).select((at(last - points * MINUTE) + F.make_dt_interval(mins=F.col("id").cast("int"))).alias("minute"))
    # counts without a group have a row a minute, so points of them at most are left
    near = counts.where((F.col("bucket_start") >= at(last - points * MINUTE)) & (F.col("bucket_start") < at(last))).groupBy("bucket_start").agg(F.sum("cnt").alias("cnt"))
    return series.join(F.broadcast(near), F.col("minute") == F.col("bucket_start"), "left").select("minute", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def normalised(series: DataFrame) -> DataFrame:
    """Each count as a percentage of the highest."""
    peak = F.greatest(F.lit(1), F.max("cnt").over(Window.partitionBy()))
    return series.select("minute", "cnt", F.round(F.col("cnt") / peak * 100).cast("long").alias("percent"))
