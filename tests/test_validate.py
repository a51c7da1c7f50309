import json

import pytest

from cinderlog.operators import validate
from cinderlog.operators.params import micros_of

NOW = micros_of("2026-08-12T12:00:00Z")
GOOD = {"timestamp": "2026-08-12T11:00:00Z", "level": "info", "service": "s", "message": "m"}


def check(spark, entries):
    """Reasons of entries (dicts or JSON texts), in order."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    body = '{"logs": [' + ", ".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + "]}"
    found = validate.validated(validate.entries(validate.requests(spark.createDataFrame([(body,)], "body string"))), NOW)
    return sorted(found.collect(), key=lambda r: r["index"])


CASES = [
    (GOOD, None),
    ("1", "entry must be an object"),
    ("null", "entry must be an object"),
    ("[]", "entry must be an object"),
    ({k: v for k, v in GOOD.items() if k != "timestamp"}, "missing required field: timestamp"),
    (GOOD | {"timestamp": None}, "missing required field: timestamp"),
    (GOOD | {"timestamp": 5}, "timestamp must be an ISO 8601 string"),
    (GOOD | {"timestamp": "not-a-date"}, "invalid timestamp: 'not-a-date'"),
    (GOOD | {"timestamp": "12:00"}, "invalid timestamp: '12:00'"),
    (GOOD | {"timestamp": "2026-02-30T00:00:00Z"}, "invalid timestamp: '2026-02-30T00:00:00Z'"),
    (GOOD | {"timestamp": "2026-08-12T12:05:00Z"}, None),
    (GOOD | {"timestamp": "2026-08-12T12:05:00.001Z"}, "timestamp is more than 5 minutes in the future"),
    (GOOD | {"timestamp": "2026-08-12T15:00:00+03:00"}, None),
    (GOOD | {"timestamp": "1999-01-01"}, None),
    (GOOD | {"level": None}, "missing required field: level"),
    (GOOD | {"level": "critical"}, "invalid level: 'critical', expected one of debug, info, warn, error"),
    (GOOD | {"level": "INFO"}, "invalid level: 'INFO', expected one of debug, info, warn, error"),
    (GOOD | {"level": 3}, "invalid level: '3', expected one of debug, info, warn, error"),
    ({k: v for k, v in GOOD.items() if k != "service"}, "missing required field: service"),
    (GOOD | {"service": 1}, "service must be a string"),
    (GOOD | {"service": ""}, "service must be a non-empty string"),
    (GOOD | {"service": " "}, None),
    (GOOD | {"service": "a\x00b"}, "service must not contain null bytes"),
    (GOOD | {"message": {}}, "message must be a string"),
    (GOOD | {"message": "a\x00b"}, "message must not contain null bytes"),
    (GOOD | {"message": "x" * 100_000}, None),
    (GOOD | {"attributes": None}, None),
    (GOOD | {"attributes": [1]}, "attributes must be an object"),
    (GOOD | {"attributes": "x"}, "attributes must be an object"),
    (GOOD | {"attributes": {"a\x00": 1}}, "attribute keys must not contain null bytes"),
    (GOOD | {"attributes": {"a": "x\x00"}}, "attribute 'a' must not contain null bytes"),
    (GOOD | {"attributes": {"a": None}}, "attribute 'a' must be a string, number, or boolean"),
    (GOOD | {"attributes": {"a": {"b": 1}}}, "attribute 'a' must be a string, number, or boolean"),
    (GOOD | {"attributes": {"z": [], "a": []}}, "attribute 'a' must be a string, number, or boolean"),
    (GOOD | {"timestamp": None, "level": "bad"}, "missing required field: timestamp"),
]


def test_reasons(spark):
    assert [r["reason"] for r in check(spark, [e for e, _ in CASES])] == [reason for _, reason in CASES]


def test_infinite_number(spark):
    entry = json.dumps(GOOD)[:-1] + ', "attributes": {"a": 1e400}}'
    assert check(spark, [entry])[0]["reason"] == "attribute 'a' must be a finite number"


def test_normal_form(spark):
    entry = GOOD | {"timestamp": "2026-08-12T11:00:00.123456Z", "service": "'; DROP TABLE logs; --", "message": "سجل ログ 🙂", "attributes": {"retries": 3, "ok": True, "id": "42", "ratio": 0.25, "big": 1e21, "__proto__": "x"}}
    row = check(spark, [entry])[0]
    assert row["attributes"] == {"retries": "3", "ok": "true", "id": "42", "ratio": "0.25", "big": "1e+21", "__proto__": "x"}
    assert row["timestamp"].microsecond == 123000
    assert (row["service"], row["message"]) == (entry["service"], entry["message"])


def test_last_of_equal_keys_counts(spark):
    entry = json.dumps(GOOD)[:-1] + ', "level": "warn", "attributes": {"a": 1, "a": 2}}'
    row = check(spark, [entry])[0]
    assert (row["level"], row["attributes"]) == ("warn", {"a": "2"})


def test_many(spark):
    rows = check(spark, [GOOD | {"message": f"m{i}", "attributes": {f"k{j}": j for j in range(200)} if i == 7 else {}} for i in range(2000)])
    assert len(rows) == 2000 and all(r["reason"] is None for r in rows)
    assert len(rows[7]["attributes"]) == 200


@pytest.mark.parametrize(
    ("body", "reason"),
    [
        ('{"logs": [', "request body is not valid JSON"),
        ("[]", "request body must be an object"),
        ("5", "request body must be an object"),
        ("{}", "missing required field: logs"),
        ('{"logs": 5}', "logs must be an array"),
        ('{"logs": []}', "logs must not be empty"),
        ('{"logs": [{}]}', None),
        ('{"logs": ["' + "x" * (10 * 1024 * 1024) + '"]}', "request body is too large"),
    ],
)
def test_envelopes(spark, body, reason):
    assert validate.requests(spark.createDataFrame([(body,)], "body string")).first()["refused"] == reason


def test_answers(spark):
    bodies = [(1, json.dumps({"logs": [GOOD, GOOD | {"level": "x"}, GOOD, GOOD | {"timestamp": "y"}]})), (2, json.dumps({"logs": [GOOD | {"level": "x"}]}))]
    checked = validate.validated(validate.entries(validate.requests(spark.createDataFrame(bodies, "request_id int, body string"))), NOW)
    a, b = sorted(validate.answers(checked, ["request_id"]).collect(), key=lambda r: r["request_id"])
    assert (a["accepted"], [x["index"] for x in a["rejected"]], a["status"]) == (2, [1, 3], 200)
    assert (b["accepted"], len(b["rejected"]), b["status"]) == (0, 1, 400)
    assert validate.accepted(checked).count() == 2 and validate.rejected(checked).count() == 3
