"""Request bodies from files (a file is a body), and answers as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(request_id, body): the file's name and its whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("body"))


def stream_bodies(spark: SparkSession, path: str, files_per_trigger: int | None = None, lines: bool = False) -> DataFrame:
    """(request_id, body) of the files, or (file, block, body) of their lines: block is where the part of the file begins that the line was read with."""
    reader = spark.readStream.format("text").option("wholetext", str(not lines).lower())
    if files_per_trigger:
        # what isn't read yet waits in the folder: this is the limit on work in flight
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    found = reader.load(path)
    if lines:
        return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("body"))
    return found.select(F.col("_metadata.file_path").alias("request_id"), F.col("value").alias("body"))


def as_json(table: DataFrame) -> DataFrame:
    """Each row as one JSON text; ids as text, times to the microsecond in UTC."""
    shown = [F.col(c).cast("string").alias(c) if c == "id" else F.col(c) for c in table.columns]
    return table.select(F.to_json(F.struct(*shown), _JSON).alias("value"))


def page_document(page: DataFrame, limit: int) -> DataFrame:
    """One document {logs, next_cursor} of a page and a row more (as top() gives them), newest first; the cursor is null on the last page."""
    shown = F.struct((-F.unix_micros("timestamp")).alias("t"), (-F.col("id")).alias("i"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), "timestamp", "level", "service", "message", "attributes"), _JSON).alias("row"))
    whole = page.agg(F.sort_array(F.collect_list(shown)).alias("rows"))
    last = F.get("rows", limit - 1)
    text = F.concat(F.lit('{"t":"'), F.date_format(F.timestamp_micros(-last["t"]), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('","i":"'), (-last["i"]).cast("string"), F.lit('"}'))
    cursor = F.when(F.size("rows") > limit, F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("=")))
    logs = F.array_join(F.transform(F.slice("rows", 1, limit), lambda r: r["row"]), ",")
    shown = F.coalesce(F.concat(F.lit('"'), cursor, F.lit('"')), F.lit("null"))
    return whole.select(F.concat(F.lit('{"logs":['), logs, F.lit('],"next_cursor":'), shown, F.lit("}")).alias("value"))


def buckets_document(counts: DataFrame) -> DataFrame:
    """One document {buckets} of counts (bucket_start, grp, cnt), in their order; a count without a group has a null one."""
    row = F.struct(F.col("bucket_start").alias("start"), F.col("grp").alias("group"), F.col("cnt").alias("count"))
    whole = counts.agg(F.sort_array(F.collect_list(row)).alias("buckets"))
    return whole.select(F.to_json(F.struct("buckets"), _JSON).alias("value"))


def write_json(table: DataFrame, path: str) -> None:
    as_json(table).write.mode("overwrite").text(path)
