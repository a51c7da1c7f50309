"""Newest-first search in pages; the order (timestamp, id) is total."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from cinderlog.functions.buckets import minute_of
from cinderlog.model import MICRO, Filters, Position
from cinderlog.operators import cursor as cursors
from cinderlog.operators.predicates import apply

COLUMNS = ("id", "timestamp", "level", "service", "message", "attributes")
#: Windows searched first where a filter is costly, newest first, in seconds.
STAGES = (3600, 86400)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    has_more: bool
    next_cursor: str | None


def top(logs: DataFrame, filters: Filters, n: int, position: Position | None = None) -> DataFrame:
    """The n newest matches: a pruned scan and a top-k per task."""
    found = apply(logs, filters, position)
    return found.orderBy(F.desc("timestamp"), F.desc("id")).limit(n).select(*(c for c in COLUMNS if c in logs.columns))


def _position(filters: Filters) -> Position | None:
    return cursors.decode(filters.cursor) if filters.cursor else None


def windows(filters: Filters, position: Position | None, now: int) -> list[Filters]:
    """The ranges to try in turn: recent ones first where text or attributes are filtered, the whole one last."""
    if not filters.q and not filters.attributes:
        return [filters]
    upper = position.micros if position else filters.until if filters.until is not None else now
    out = []
    for seconds in STAGES:
        since = upper - seconds * MICRO
        if filters.since is not None and since <= filters.since:
            break
        out.append(replace(filters, since=since))
    return [*out, filters]


def search(logs: DataFrame, filters: Filters, now: int) -> Page:
    """One page. A stage counts only if it gives more rows than a page holds, so stages never change the answer."""
    position = _position(filters)
    rows: list[Row] = []
    for stage in windows(filters, position, now):
        micros = F.unix_micros("timestamp").alias("_micros")
        rows = top(logs, stage, filters.limit + 1, position).select("*", micros).orderBy(F.desc("timestamp"), F.desc("id")).collect()
        if len(rows) > filters.limit:
            break
    more = len(rows) > filters.limit
    rows = rows[: filters.limit]
    after = cursors.encode(Position(rows[-1]["_micros"], rows[-1]["id"])) if more else None
    return Page(rows, more, after)


def pages(logs: DataFrame, filters: Filters, now: int) -> Iterator[Page]:
    """All pages, each from the cursor of the one before."""
    while True:
        page = search(logs, filters, now)
        yield page
        if page.next_cursor is None:
            return
        filters = replace(filters, cursor=page.next_cursor)


def staged(logs: DataFrame, filters: Filters, now: int) -> DataFrame:
    """The page that search() gives, as a table: a stage's rows stay where they are, only their number is looked at."""
    position = _position(filters)
    *early, whole = windows(filters, position, now)
    for stage in early:
        # a limited count stops as soon as the page is full
        if top(logs, stage, filters.limit + 1, position).count() > filters.limit:
            return top(logs, stage, filters.limit, position)
    return top(logs, whole, filters.limit, position)


def all_pages(logs: DataFrame, filters: Filters) -> DataFrame:
    """Every match with the number of its page (from 0), as following the cursors would give them.

    Matches are counted by minute; a running sum over that small table says how many are newer than a minute, and rows
    are numbered within their minute. So no task sees more than one minute's rows, and the driver sees none.
    """
    found = apply(logs, filters, _position(filters)).withColumn("minute", minute_of(F.col("timestamp")))
    newer = Window.orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    before = found.groupBy("minute").agg(F.count("*").alias("c")).select("minute", F.coalesce(F.sum("c").over(newer), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("minute").orderBy(F.desc("timestamp"), F.desc("id"))) - 1
    rows = found.join(before, "minute").withColumn("place", F.col("before") + place)
    return rows.select(*(c for c in COLUMNS if c in logs.columns), F.floor(F.col("place") / filters.limit).cast("long").alias("page"))
