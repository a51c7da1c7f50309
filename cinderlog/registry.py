"""Where queries are registered beside the SQL that must give the same rows, and what their modules share.

Times are shown without zone, in UTC; nothing reads the clock, as the events are of January 2024.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The canonical view in SQL.
LOGS = """WITH logs AS (
  SELECT event_id AS id, ts AS timestamp,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'view' THEN 'debug' ELSE 'info' END AS level,
    'svc-' || (user_id % 5) AS service, event_type || ' by user ' || user_id AS message,
    json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS user_id, event_type
  FROM events) """
WIDTHS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
#: Ranges of the queries: a month, a day, and ones with odd edges.
MONTH = ("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z")
DAY = ("2024-01-10T00:00:00Z", "2024-01-11T00:00:00Z")
ODD = ("2024-01-03T04:05:06.789Z", "2024-01-20T21:22:23.456Z")


def sql_time(text: str) -> str:
    return f"TIMESTAMP '{text.rstrip('Z').replace('T', ' ')}'"


def sql_text(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _bare(df: DataFrame) -> DataFrame:
    """Times without zone."""
    return df.select(*(F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema))


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _bare(build(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return register
