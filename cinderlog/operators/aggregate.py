"""Counts by time bucket, from raw rows or from the rollups wherever those are exact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.buckets import at, bucket_start, minute_of
from cinderlog.model import MICRO, MINUTE, AggregateParams, Filters
from cinderlog.operators.predicates import apply
from cinderlog.plans.sections import FOREVER, Section, sections

_GROUPS = {"service": "service", "level": "level"}


def _group(params: AggregateParams) -> Column:
    name = _GROUPS[params.group_by] if params.group_by else None
    return (F.col(name) if name else F.lit(None).cast("string")).alias("grp")


def _ordered(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.asc("bucket_start"), F.asc_nulls_first("grp"))


def raw_counts(logs: DataFrame, params: AggregateParams) -> DataFrame:
    """(bucket_start, grp, cnt) of the matching rows; empty buckets are left out."""
    rows = apply(logs, params.filters)
    return _ordered(rows.groupBy(bucket_start(F.col("timestamp"), params.bucket).alias("bucket_start"), _group(params)).agg(F.count("*").alias("cnt")))


def can_use_rollup(filters: Filters) -> bool:
    """Counters know service and level only."""
    return not filters.attributes and filters.q is None


def _dimensions(filters: Filters) -> Filters:
    return Filters(service=filters.service, level=filters.level)


def _span(table: DataFrame, section: Section, filters: Filters) -> DataFrame:
    """Whole buckets of a rollup, as (minute, service, level, count)."""
    rows = apply(table, _dimensions(filters)).where((F.col("bucket") >= at(section.start)) & (F.col("bucket") < at(section.end)))
    return rows.select(minute_of(F.col("bucket")).alias("minute"), "service", "level", "count")


def _raw_span(logs: DataFrame, section: Section, filters: Filters) -> DataFrame:
    rows = apply(logs, Filters(filters.service, filters.level, section.start, section.end))
    return rows.select(minute_of(F.col("timestamp")).alias("minute"), "service", "level", F.lit(1).cast("long").alias("count"))


def _guarded(logs: DataFrame, seconds: DataFrame, section: Section, filters: Filters) -> list[DataFrame]:
    """A part of a second both ways, each under a guard of which one holds: its counter if the rest of the second is
    empty, else its raw rows."""
    start = section.start - section.start % MICRO
    gaps = [(a, b) for a, b in ((start, section.start), (section.end, start + MICRO)) if a < b]
    rest = [apply(logs, Filters(filters.service, filters.level, a, b)).select("timestamp") for a, b in gaps]
    empty = reduce(DataFrame.unionByName, rest).agg(F.min("timestamp")).scalar().isNull()
    return [_span(seconds, Section("second", start, start + MICRO), filters).where(empty), _raw_span(logs, section, filters).where(~empty)]


def rollup_counts(logs: DataFrame, seconds: DataFrame, minutes: DataFrame, params: AggregateParams, second_from: int = FOREVER, guards: bool = False) -> DataFrame:
    """The same rows as raw_counts, of whole minutes and seconds by counters and of the edges by raw rows."""
    f = params.filters
    parts: list[DataFrame] = []
    for s in sections(f.since, f.until, second_from):
        if s.grain == "minute":
            parts.append(_span(minutes, s, f))
        elif s.grain == "second":
            parts.append(_span(seconds, s, f))
        elif guards and s.start // MICRO == (s.end - 1) // MICRO and s.start - s.start % MINUTE >= second_from:
            parts += _guarded(logs, seconds, s, f)
        else:
            parts.append(_raw_span(logs, s, f))
    whole = reduce(DataFrame.unionByName, parts)
    counts = whole.groupBy(bucket_start(F.col("minute"), params.bucket).alias("bucket_start"), _group(params)).agg(F.sum("count").cast("long").alias("cnt"))
    return _ordered(counts)


def aggregate(logs: DataFrame, seconds: DataFrame, minutes: DataFrame, params: AggregateParams, second_from: int = FOREVER) -> DataFrame:
    """The router: counters where they know all filters, raw rows otherwise."""
    if can_use_rollup(params.filters):
        return rollup_counts(logs, seconds, minutes, params, second_from)
    return raw_counts(logs, params)
