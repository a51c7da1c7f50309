"""Request bodies made of the driver's events, with faults in known entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.sources import events

#: By remainder of the id, a reason and what is wrong in the entry's JSON by field (None: not there), or the whole entry.
Faults = dict[int, tuple[str, Callable[[dict], dict | str]]]
FAULTS: Faults = {
    0: ("missing required field: timestamp", lambda e: e | {"timestamp": None}),
    1: ("invalid level: 'critical', expected one of debug, info, warn, error", lambda e: e | {"level": '"critical"'}),
    2: ("service must be a non-empty string", lambda e: e | {"service": '""'}),
    3: ("message must be a string", lambda e: e | {"message": "17"}),
    4: ("attributes must be an object", lambda e: e | {"attributes": "[1]"}),
    5: ("attribute 'k' must be a string, number, or boolean", lambda e: e | {"attributes": '{"k": null}'}),
    6: ("invalid timestamp: '12:00'", lambda e: e | {"timestamp": '"12:00"'}),
    7: ("timestamp is more than 5 minutes in the future", lambda e: e | {"timestamp": '"2024-02-01T00:05:00.001Z"'}),
}
#: The faults that FAULTS doesn't have.
MORE_FAULTS: Faults = {
    0: ("entry must be an object", lambda e: '"text"'),
    1: ("timestamp must be an ISO 8601 string", lambda e: e | {"timestamp": "1704067200"}),
    2: ("missing required field: level", lambda e: e | {"level": None}),
    3: ("invalid level: '3', expected one of debug, info, warn, error", lambda e: e | {"level": "3"}),
    4: ("missing required field: service", lambda e: e | {"service": "null"}),
    5: ("service must be a string", lambda e: e | {"service": "true"}),
    6: ("service must not contain null bytes", lambda e: e | {"service": '"a\\u0000"'}),
    7: ("missing required field: message", lambda e: e | {"message": None}),
    8: ("message must be a non-empty string", lambda e: e | {"message": '""'}),
    9: ("message must not contain null bytes", lambda e: e | {"message": '"\\u0000"'}),
    10: ("attribute keys must not contain null bytes", lambda e: e | {"attributes": '{"a\\u0000": 1}'}),
    11: ("attribute 'k' must not contain null bytes", lambda e: e | {"attributes": '{"k": "x\\u0000y"}'}),
    12: ("attribute 'k' must be a string, number, or boolean", lambda e: e | {"attributes": '{"k": {"a": 1}}'}),
}
PER_REQUEST = 50
#: Entries of a request that has a file of its own: some 200 kB, whatever the number of events is.
PER_FILE = 1000


def request_bodies(spark: SparkSession, sf_dir: str, faults: Faults = FAULTS, modulus: int = 10, per_request: int = PER_REQUEST) -> DataFrame:
    """Requests (request_id, body) made of the events, with their faults."""
    logs = events.logs(spark, sf_dir)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    whole = {
        "timestamp": quoted(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
        "level": quoted(F.col("level")),
        "service": quoted(F.col("service")),
        "message": quoted(F.col("message")),
        "attributes": F.concat(F.lit('{"k": '), F.col("attributes")["k"], F.lit('.0, "user": '), quoted(F.col("attributes")["user_id"]), F.lit(', "odd": '), (F.col("id") % 2 == 1).cast("string"), F.lit("}")),
    }

    def text(entry: dict | str) -> Column:
        if isinstance(entry, str):
            return F.lit(entry)
        given = {k: F.lit(v) if isinstance(v, str) else v for k, v in entry.items() if v is not None}
        parts = [x for i, (k, v) in enumerate(given.items()) for x in (F.lit(f'{", " if i else ""}"{k}": '), v)]
        return F.concat(F.lit("{"), *parts, F.lit("}"))

    entry = text(whole)
    for k, (_, fault) in faults.items():
        entry = F.when(F.col("id") % modulus == k, text(fault(dict(whole)))).otherwise(entry)
    order = F.sort_array(F.collect_list(F.struct("id", entry.alias("entry"))))
    body = F.concat(F.lit('{"logs": ['), F.array_join(F.transform(order, lambda e: e["entry"]), ", "), F.lit("]}"))
    return logs.groupBy(F.floor(F.col("id") / per_request).cast("long").alias("request_id")).agg(body.alias("body"))


def body_files(spark: SparkSession, sf_dir: str, to: str) -> None:
    """Writes requests made of the events, each as a file of its own."""
    request_bodies(spark, sf_dir, per_request=PER_FILE).select("body").write.option("maxRecordsPerFile", 1).text(to)


def line_files(spark: SparkSession, sf_dir: str, to: str, files: int) -> None:
    """Writes requests made of the events, one a line, to so many files."""
    part = F.pmod("request_id", F.lit(files)).alias("part")
    request_bodies(spark, sf_dir).select(part, "body").repartition("part").write.partitionBy("part").text(to)
