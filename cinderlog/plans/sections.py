"""Which stored grain answers which part of a time range: plain integers, no Spark."""

from __future__ import annotations

from dataclasses import dataclass

from cinderlog.model import MICRO, MINUTE

FOREVER = 2**62


@dataclass(frozen=True)
class Section:
    """[start, end) in microseconds, answered by whole "minute" or "second" rows or by "raw" rows."""

    grain: str
    start: int
    end: int


def _floor(x: int, width: int) -> int:
    return x - x % width


def _ceil(x: int, width: int) -> int:
    return -(-x // width) * width


def _edge(start: int, end: int, second_from: int) -> list[Section]:
    """A part of a minute: whole seconds from the second rollup where it is complete, the rest raw."""
    first, last = max(_ceil(start, MICRO), _ceil(second_from, MICRO)), _floor(end, MICRO)
    if first >= last:
        return [Section("raw", start, end)]
    parts = [Section("raw", start, first), Section("second", first, last), Section("raw", last, end)]
    return [p for p in parts if p.start < p.end]


def sections(since: int, until: int, second_from: int = FOREVER) -> list[Section]:
    """Disjoint parts that make up [since, until); the second rollup is complete from second_from on."""
    if until <= since:
        return []
    first, last = _ceil(since, MINUTE), _floor(until, MINUTE)
    if first >= last:
        # no whole minute; still cut at a minute's start, so that no part spans two
        cut = first if since < first < until else until
        return [s for a, b in ((since, cut), (cut, until)) if a < b for s in _edge(a, b, second_from)]
    parts = _edge(since, first, second_from) if since < first else []
    parts.append(Section("minute", first, last))
    return parts + (_edge(last, until, second_from) if last < until else [])
