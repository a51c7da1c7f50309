import pytest

from cinderlog.model import BadRequest, Position
from cinderlog.operators.cursor import decode, encode
from cinderlog.operators.params import iso_of, micros_of, number_of, parse_aggregate, parse_filters

NEEDED = {"since": "2026-08-12T00:00:00Z", "until": "2026-08-13T00:00:00Z", "bucket": "1h"}


@pytest.mark.parametrize(
    ("query", "message"),
    [
        ({"attr.": "x"}, "invalid attribute filter: empty key"),
        ({"service": ""}, "service must be a non-empty string"),
        ({"level": "critical"}, "invalid level: 'critical'"),
        ({"level": "INFO"}, "invalid level: 'INFO'"),
        ({"since": "not-a-date"}, "invalid since: 'not-a-date' is not a valid ISO 8601 timestamp"),
        ({"until": "12:00"}, "invalid until: '12:00' is not a valid ISO 8601 timestamp"),
        ({"limit": "abc"}, "invalid limit: 'abc' is not an integer"),
        ({"limit": "1.5"}, "invalid limit: '1.5' is not an integer"),
        ({"limit": "0"}, "invalid limit: must be between 1 and 1000"),
        ({"limit": ""}, "invalid limit: must be between 1 and 1000"),
        ({"limit": "5000"}, "invalid limit: must be between 1 and 1000"),
        ({"since": "2026-08-12", "until": "2026-08-12"}, "until must be later than since"),
        ({"since": "2026-08-13", "until": "2026-08-12"}, "until must be later than since"),
    ],
)
def test_refused_filters(query, message):
    with pytest.raises(BadRequest) as e:
        parse_filters(query)
    assert str(e.value) == message


@pytest.mark.parametrize(("text", "limit"), [("1e2", 100), ("0x10", 16), ("5.0", 5), (" 7 ", 7), ("1000", 1000), ("+3", 3)])
def test_limits(text, limit):
    assert parse_filters({"limit": text}).limit == limit


def test_filters():
    f = parse_filters([("service", "a"), ("service", "b"), ("unknown", "x"), ("attr.k", ""), ("attr.__proto__", "x"), ("q", ""), ("cursor", "")])
    assert (f.service, f.attributes, f.q, f.cursor, f.limit) == ("a", {"k": "", "__proto__": "x"}, None, None, 100)
    assert parse_filters({"service": ["first", "second"]}).service == "first"
    assert parse_filters({"service": 5}).service is None


@pytest.mark.parametrize("name", ["since", "until", "bucket"])
def test_aggregate_needs(name):
    with pytest.raises(BadRequest, match=f"missing required parameter: {name}"):
        parse_aggregate({k: v for k, v in NEEDED.items() if k != name})


def test_aggregate_refusals():
    for more, message in [
        ({"bucket": "2h"}, "invalid bucket: '2h', expected one of 1m, 5m, 1h, 1d"),
        ({"bucket": ["1h", "1d"]}, "missing required parameter: bucket"),
        ({"group_by": "message"}, "invalid group_by: expected one of service, level"),
        ({"group_by": ["level", "level"]}, "invalid group_by: expected one of service, level"),
        ({"limit": "abc"}, "invalid limit: 'abc' is not an integer"),
    ]:
        with pytest.raises(BadRequest) as e:
            parse_aggregate(NEEDED | more)
        assert str(e.value) == message
    assert parse_aggregate(NEEDED | {"cursor": "garbage", "group_by": "level"}).group_by == "level"


def test_times():
    assert micros_of("1970-01-01") == 0
    assert micros_of("1970-01-01T03:00:00+03:00") == 0
    assert micros_of("1969-12-31T23:59:59.999999Z") == -1
    assert micros_of("2026-02-30") is None
    assert iso_of(micros_of("2026-08-12T12:00:00.123456Z")) == "2026-08-12T12:00:00.123456Z"
    assert number_of("Infinity") is None


@pytest.mark.parametrize("position", [Position(1786536000123456, 4521), Position(0, 9007199254740993), Position(-1, 0)])
def test_cursor_round_trip(position):
    text = encode(position)
    assert decode(text) == position
    assert all(c.isalnum() or c in "-_" for c in text)


@pytest.mark.parametrize("bad", ["garbage", "", "e30", "W10", "bnVsbA", "eyJ0IjoxLCJpIjoiMSJ9", "eyJ0IjoiMjAyNi0wOC0xMlQxMjowMDowMFoiLCJpIjoieCJ9", "!!!!", "eyJ0IjoiMjAyNi0wOC0xMlQxMjowMDowMFoiLCJpIjo1fQ"])
def test_bad_cursors(bad):
    with pytest.raises(BadRequest, match="invalid cursor"):
        decode(bad)
