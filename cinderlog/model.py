"""Schemas and fixed values of the log store."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# fixed values of the service's contract
LEVELS = ("debug", "info", "warn", "error")
MAX_BODY_BYTES = 10 * 1024 * 1024
DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
FUTURE_MINUTES = 5
RETENTION_DAYS, SECOND_WINDOW_MINUTES, DRIFT_TOLERANCE = 30, 120, 0

MICRO = 1_000_000
MINUTE = 60 * MICRO

LOGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("message", T.StringType(), False),
        T.StructField("attributes", T.MapType(T.StringType(), T.StringType(), False), False),
    ]
)
ROLLUP = T.StructType(
    [
        T.StructField("bucket", T.TimestampType(), False),
        T.StructField("service", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("count", T.LongType(), False),
    ]
)


class BadRequest(ValueError):
    """A parameter that the service refuses; str() is the message of its answer."""


@dataclass(frozen=True)
class Position:
    """A place in the order (timestamp, id), in microseconds since 1970."""

    micros: int
    id: int


@dataclass(frozen=True)
class Filters:
    service: str | None = None
    level: str | None = None
    since: int | None = None
    until: int | None = None
    attributes: dict[str, str] = field(default_factory=dict)
    q: str | None = None
    limit: int = DEFAULT_LIMIT
    cursor: str | None = None


@dataclass(frozen=True)
class AggregateParams:
    filters: Filters
    bucket: str
    group_by: str | None = None
