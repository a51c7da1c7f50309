"""Filters as one conjunction of columns; values are literals, never text of a query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.buckets import at, day_of
from cinderlog.model import Filters, Position


def _range(since: int | None, until: int | None, by_day: bool) -> list[Column]:
    """since <= timestamp < until; the same for the day, so that whole partitions are left out."""
    out = []
    if since is not None:
        out.append(F.col("timestamp") >= at(since))
        if by_day:
            out.append(F.col("day") >= day_of(at(since)))
    if until is not None:
        out.append(F.col("timestamp") < at(until))
        if by_day:
            out.append(F.col("day") <= day_of(at(until - 1)))
    return out


def before(position: Position, by_day: bool = False) -> Column:
    """Rows after a position in newest-first order, in a form that file statistics can use."""
    t = at(position.micros)
    out = (F.col("timestamp") <= t) & ((F.col("timestamp") < t) | (F.col("id") < position.id))
    return out & (F.col("day") <= day_of(t)) if by_day else out


def contains_text(column: Column, text: str) -> Column:
    """Case-insensitive; every character stands for itself."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def conditions(filters: Filters, position: Position | None = None, by_day: bool = False) -> list[Column]:
    out = []
    if filters.service is not None:
        out.append(F.col("service") == F.lit(filters.service))
    if filters.level is not None:
        out.append(F.col("level") == F.lit(filters.level))
    out += _range(filters.since, filters.until, by_day)
    out += [F.col("attributes")[F.lit(k)] == F.lit(v) for k, v in filters.attributes.items()]
    if filters.q is not None:
        out.append(contains_text(F.col("message"), filters.q))
    if position is not None:
        out.append(before(position, by_day))
    return out


def apply(logs: DataFrame, filters: Filters, position: Position | None = None) -> DataFrame:
    """The rows that match all filters; uses the partition column day where the table has one."""
    found = conditions(filters, position, "day" in logs.columns)
    return logs.where(reduce(lambda a, b: a & b, found)) if found else logs
