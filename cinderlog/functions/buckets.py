"""Tumbling time buckets in UTC, half open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog.model import MICRO

#: Bucket names of the API with their widths in seconds.
BUCKETS = {"1m": 60, "5m": 300, "1h": 3600, "1d": 86400}


def floor_to(ts: Column, seconds: int) -> Column:
    """The start of the bucket of so many seconds, by integer arithmetic, also before 1970."""
    width = seconds * MICRO
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def bucket_start(ts: Column, bucket: str) -> Column:
    return floor_to(ts, BUCKETS[bucket])


def second_of(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def at(micros: int) -> Column:
    """A literal time."""
    return F.timestamp_micros(F.lit(micros))
