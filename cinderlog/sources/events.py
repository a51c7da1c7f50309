"""The canonical view: the driver's events as logs, and other sources in the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Services of the view.
SERVICES = 5


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, its times read as UTC: without a cast in between, comparisons with them reach the file's statistics."""
    path = f"{sf_dir}/events.parquet"
    kinds = {f.name: T.TimestampType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType for f in spark.read.parquet(path).schema}
    return spark.read.schema(T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])).parquet(path)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as logs."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "purchase", "warn").when(kind == "view", "debug").otherwise("info")
    user = F.col("user_id").cast("string")
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("svc-"), F.pmod("user_id", F.lit(SERVICES)).cast("string")).alias("service"),
        F.concat(kind, F.lit(" by user "), user).alias("message"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user_id"), user, F.lit("event_type"), kind).alias("attributes"),
    )
