"""Ingest as a stream: request files become stored logs, one committed batch a trigger.

Counting is stateless: a batch appends its own counters, so rows of any age count and none is dropped as late. The
batch id of the stream names the stored batch, so a trigger that is run again after a failure commits once. Requests
wait in their folder until a trigger reads them, at most files_per_trigger at once; that is the limit on work in flight.
A file is one request, or holds one on each line: files may then be of any size, and the limit of a body holds for a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderlog.operators import validate
from cinderlog.sources.requests import stream_bodies
from cinderlog.sources.store import Store


#: Requests in flight at most; others wait in their folder.
FILES_PER_TRIGGER = 10_000


def numbered(bodies: DataFrame) -> DataFrame:
    """Requests (request_id, body) with their number in the batch.

    A batch's requests are ranked by their names alone, which are few (files_per_trigger) and short.
    """
    names = bodies.select("request_id").distinct().withColumn("number", F.row_number().over(Window.orderBy("request_id")).cast("long") - 1)
    return bodies.join(names, "request_id")


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Requests (request_id, body, number) of a batch's lines (file, block, body); a request is named by its file and its line's place, from 0.

    Places are ranked within a file, without the bodies; across files only their counts are summed.
    """
    placed = lines.withColumn("at", F.monotonically_increasing_id())
    names = placed.select("at", "file", (F.row_number().over(Window.partitionBy("file").orderBy("block", "at")).cast("long") - 1).alias("line"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    files = lines.groupBy("file").agg(F.count("*").alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("before"))
    names = names.join(F.broadcast(files), "file").select("at", F.concat_ws("#", "file", "line").alias("request_id"), (F.col("before") + F.col("line")).alias("number"))
    return placed.join(names, "at").select("request_id", "body", "number")


def numbered_entries(requests: DataFrame, now: int) -> DataFrame:
    """Validated entries of all requests (request_id, body, number), with the request's number in the batch."""
    return validate.validated(validate.entries(validate.requests(requests)), now)


def ingest(spark: SparkSession, source: str, store: Store, checkpoint: str, now: Callable[[], int], answers: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER, trigger: dict | None = None, lines: bool = False) -> StreamingQuery:
    """Starts the stream; trigger defaults to all that is there (availableNow). Answers, if wanted, are written as JSON by batch.

    lines: each line of a file is a request.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")

    def commit(batch: DataFrame, number: int) -> None:
        checked = numbered_entries(numbered_lines(batch) if lines else numbered(batch), now()).persist()
        try:
            store.append(f"stream-{number}", validate.accepted(checked).withColumnRenamed("number", "request"))
            if answers:
                validate.answers(checked, ["request_id"]).write.mode("overwrite").json(f"{answers}/batch={number}")
        finally:
            checked.unpersist()

    query = stream_bodies(spark, source, files_per_trigger, lines).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return query.trigger(**(trigger or {"availableNow": True})).start()
