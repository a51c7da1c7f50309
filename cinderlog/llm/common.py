"""What the operators share: table reading, a table in the shared folder, key columns and checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of most operators: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A table is broadcast only if it has been counted and is below this many bytes.
BROADCAST_BYTES = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where the session names none and all executors are on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"{tempfile.gettempdir()}/cinderlog-shared"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/cinderlog-{spark.sparkContext.applicationId}"


def stash(df: DataFrame, name: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and lost executors take nothing with them.

    Results may still read these tables, so they stay until drop_stash() or clear_stashes(). Rows of each value of a column
    `by` are in files of their own, so that plans of some values read no others.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(df.columns) if by else out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_stashes(spark: SparkSession) -> None:
    """Deletes all tables that this application has stashed, once no result needs them."""
    _delete(spark, _own_dir(spark))


def drop_stash(df: DataFrame) -> None:
    """Deletes the stashes that df reads, once no later plan reads them; other files stay."""
    own = f"/cinderlog-{df.sparkSession.sparkContext.applicationId}/"
    for above, _, name in {(*f.partition(own)[:2], f.partition(own)[2].partition("/")[0]) for f in df.inputFiles() if own in f}:
        _delete(df.sparkSession, above + own + name)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no plan refers to any more, instead of when the driver happens to collect its garbage.

    The driver's JVM and Python also give back what they have freed.
    """
    from cinderlog.llm import kernels

    gc.collect()
    # Python's references are given up by a thread of their own that looks once a second; until then the JVM's collector finds nothing
    waiting = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    until = time.monotonic() + 3
    while waiting and time.monotonic() < until:
        time.sleep(0.05)
    for _ in range(2):  # the listeners of the last query may hold its plan a little longer
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
    kernels.release()


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted rows are within the bound; else Spark's own choice of a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def text_hash(text: Column) -> Column:
    """A second key beside doc_id, so that rows with null or equal ids stay apart unless their texts are equal too."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once, however often body uses it and in however deep a function."""
    return F.get(F.transform(F.array(value), body), 0)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, by which rows are held out; null for a null doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """At most rows labelled texts (doc_id, text, label): those of least hash of doc_id; a bounded table, so it's broadcast.

    The labels are counted first, and a hash threshold leaves about as many as are wanted before they are sorted.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & learn).select("doc_id", F.col(label).cast("int").alias("label"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = (rows + 8 * rows**0.5) / max(1, known.count())
    if share < 1:
        known = known.where(place < int(share * (1 << 40)))
    return docs.select("doc_id", "text").join(F.broadcast(known.orderBy(place, "doc_id", "label").limit(rows)), "doc_id")
