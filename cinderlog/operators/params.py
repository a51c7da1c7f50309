"""Request parameters: a list of (name, value) pairs becomes filters, or the first refusal."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from datetime import datetime, timedelta, timezone

from cinderlog.functions.buckets import BUCKETS
from cinderlog.model import DEFAULT_LIMIT, LEVELS, MAX_LIMIT, MICRO, AggregateParams, BadRequest, Filters

GROUPS = ("service", "level")
ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[Tt ](\d\d):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?\s?([Zz]|[+-]\d\d:?\d\d)?)?")
_DECIMAL = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_RADIX = re.compile(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+")
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

Query = Mapping[str, object] | Iterable[tuple[str, object]]


def micros_of(text: str) -> int | None:
    """Microseconds since 1970 of an ISO 8601 time (UTC where it names no zone), or None."""
    m = ISO.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    try:
        at = datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), tzinfo=timezone.utc)
    except ValueError:
        return None
    whole = (at - _EPOCH) // timedelta(seconds=1) * MICRO + int((fraction or "0")[:6].ljust(6, "0"))
    if zone and zone not in "Zz":
        sign = -1 if zone[0] == "-" else 1
        whole -= sign * (int(zone[1:3]) * 60 + int(zone[-2:])) * 60 * MICRO
    return whole


def iso_of(micros: int) -> str:
    at = _EPOCH + timedelta(microseconds=micros)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond:06d}Z"


def number_of(text: str) -> float | None:
    """What a JavaScript Number() makes of a text; None where it isn't finite."""
    s = text.strip()
    if not s:
        return 0.0
    if _RADIX.fullmatch(s):
        return float(int(s, 0))
    return float(s) if _DECIMAL.fullmatch(s) else None


def _values(query: Query) -> dict[str, list[object]]:
    out: dict[str, list[object]] = {}
    for name, value in query.items() if isinstance(query, Mapping) else query:
        out.setdefault(name, []).extend(value if isinstance(value, list | tuple) else [value])
    return out


def _first(values: dict[str, list[object]], name: str) -> str | None:
    """The first value of a repeated parameter; one that isn't text counts as absent."""
    found = values.get(name)
    return found[0] if found and isinstance(found[0], str) else None


def _time(name: str, text: str | None) -> int | None:
    if text is None:
        return None
    at = micros_of(text)
    if at is None:
        raise BadRequest(f"invalid {name}: '{text}' is not a valid ISO 8601 timestamp")
    return at


def parse_filters(query: Query) -> Filters:
    values = _values(query)
    attributes: dict[str, str] = {}
    for name in values:
        if name.startswith("attr."):
            key, value = name[len("attr.") :], _first(values, name)
            if not key:
                raise BadRequest("invalid attribute filter: empty key")
            if value is not None:
                attributes[key] = value
    service = _first(values, "service")
    if service == "":
        raise BadRequest("service must be a non-empty string")
    level = _first(values, "level")
    if level is not None and level not in LEVELS:
        raise BadRequest(f"invalid level: '{level}'")
    since, until = (_time(name, _first(values, name)) for name in ("since", "until"))
    raw = _first(values, "limit")
    limit = DEFAULT_LIMIT
    if raw is not None:
        number = number_of(raw)
        if number is None or not number.is_integer():
            raise BadRequest(f"invalid limit: '{raw}' is not an integer")
        if not 1 <= number <= MAX_LIMIT:
            raise BadRequest(f"invalid limit: must be between 1 and {MAX_LIMIT}")
        limit = int(number)
    if since is not None and until is not None and until <= since:
        raise BadRequest("until must be later than since")
    return Filters(service, level, since, until, attributes, _first(values, "q") or None, limit, _first(values, "cursor") or None)


def parse_aggregate(query: Query) -> AggregateParams:
    filters, values = parse_filters(query), _values(query)
    for name, value in (("since", filters.since), ("until", filters.until)):
        if value is None:
            raise BadRequest(f"missing required parameter: {name}")
    bucket = values.get("bucket", [])
    if len(bucket) != 1 or not isinstance(bucket[0], str):
        raise BadRequest("missing required parameter: bucket")
    if bucket[0] not in BUCKETS:
        raise BadRequest(f"invalid bucket: '{bucket[0]}', expected one of {', '.join(BUCKETS)}")
    group = values.get("group_by", [])
    if group and (len(group) != 1 or group[0] not in GROUPS):
        raise BadRequest("invalid group_by: expected one of service, level")
    return AggregateParams(filters, bucket[0], group[0] if group else None)
