"""Queries of what the service does around the counts: requests and their refusals, documents, figures, and the store's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.bodies import MORE_FAULTS, line_files, request_bodies
from cinderlog.model import MAX_BODY_BYTES, BadRequest, Filters
from cinderlog.operators import aggregate, metrics, rollup, search, validate
from cinderlog.operators.cursor import decode
from cinderlog.operators.params import micros_of, parse_aggregate, parse_filters
from cinderlog.registry import LOGS, MONTH, query, sql_text, sql_time
from cinderlog.sources import events, requests
from cinderlog.sources.scratch import scratch
from cinderlog.sources.store import Conflict, Store
from cinderlog.streaming.ingest import ingest

# request parameters (Q1-Q13): each case answers the events of its number

_NEEDED = {"since": "2024-01-10", "until": "2024-01-11T00:00:00+01:00", "bucket": "1h"}
#: Parameters of a search, and the filters or the refusal that come of them.
_SEARCHES = [
    ([], "service=None level=None since=None until=None attributes={} q=None limit=100 cursor=None"),
    ([("service", "a"), ("service", "b"), ("unknown", "x")], "service=a level=None since=None until=None attributes={} q=None limit=100 cursor=None"),
    ([("service", 5), ("q", ""), ("cursor", "")], "service=None level=None since=None until=None attributes={} q=None limit=100 cursor=None"),
    ([("attr.k", "7"), ("attr.e", ""), ("limit", "1e2")], "service=None level=None since=None until=None attributes={'k': '7', 'e': ''} q=None limit=100 cursor=None"),
    ([("since", "2024-01-10T00:00:00.5Z"), ("until", "2024-01-10T02:00:00+01:00"), ("limit", "0x10")], "service=None level=None since=1704844800500000 until=1704848400000000 attributes={} q=None limit=16 cursor=None"),
    ([("cursor", "abc"), ("q", "A%"), ("level", "warn")], "service=None level=warn since=None until=None attributes={} q=A% limit=100 cursor=abc"),
    ([("attr.", "x")], "invalid attribute filter: empty key"),
    ([("service", "")], "service must be a non-empty string"),
    ([("level", "INFO")], "invalid level: 'INFO'"),
    ([("since", "yesterday")], "invalid since: 'yesterday' is not a valid ISO 8601 timestamp"),
    ([("until", "12:00")], "invalid until: '12:00' is not a valid ISO 8601 timestamp"),
    ([("limit", "ten")], "invalid limit: 'ten' is not an integer"),
    ([("limit", "1.5")], "invalid limit: '1.5' is not an integer"),
    ([("limit", "0")], "invalid limit: must be between 1 and 1000"),
    ([("limit", "1001")], "invalid limit: must be between 1 and 1000"),
    ([("since", "2024-01-02"), ("until", "2024-01-02")], "until must be later than since"),
    ([("until", "2024-01-01"), ("since", "2024-01-02"), ("limit", "1")], "until must be later than since"),
]
#: The same of an aggregate; a cursor that can't be read is refused by the search only.
_AGGREGATES = [
    (_NEEDED | {"group_by": "level"}, "1h by level from 1704844800000000 to 1704927600000000"),
    (_NEEDED | {"cursor": "abc"}, "1h by None from 1704844800000000 to 1704927600000000"),
    ({k: v for k, v in _NEEDED.items() if k != "since"}, "missing required parameter: since"),
    ({k: v for k, v in _NEEDED.items() if k != "until"}, "missing required parameter: until"),
    ({k: v for k, v in _NEEDED.items() if k != "bucket"}, "missing required parameter: bucket"),
    (_NEEDED | {"bucket": ["1h", "1d"]}, "missing required parameter: bucket"),
    (_NEEDED | {"bucket": "2h"}, "invalid bucket: '2h', expected one of 1m, 5m, 1h, 1d"),
    (_NEEDED | {"group_by": "message"}, "invalid group_by: expected one of service, level"),
    (_NEEDED | {"group_by": ["level", "level"]}, "invalid group_by: expected one of service, level"),
    (_NEEDED | {"limit": "ten"}, "invalid limit: 'ten' is not an integer"),
]
_CURSORS = [("eyJ0IjoiMjAyNC0wMS0xNVQxMjowMDowMC4wMDAwMDFaIiwiaSI6IjUwMCJ9", "1705320000000001 500"), ("abc", "invalid cursor"), ("", "invalid cursor"), ("eyJ0IjoxfQ", "invalid cursor")]


def _found_filters(params) -> str:
    f = parse_filters(params)
    return " ".join(f"{k}={getattr(f, k)}" for k in ("service", "level", "since", "until", "attributes", "q", "limit", "cursor"))


def _found_aggregate(params) -> str:
    p = parse_aggregate(params)
    return f"{p.bucket} by {p.group_by} from {p.filters.since} to {p.filters.until}"


def _found_cursor(text: str) -> str:
    p = decode(text)
    return f"{p.micros} {p.id}"


def _outcomes(name: str, cases: list, read) -> None:
    told = " ".join(f"WHEN {i} THEN {sql_text(want)}" for i, (_, want) in enumerate(cases))

    @query(name, LOGS + f"SELECT id % {len(cases)} AS number, CASE id % {len(cases)} {told} END AS outcome, count(*) AS asked FROM logs GROUP BY 1, 2")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        def outcome(given) -> str:
            try:
                return read(given)
            except BadRequest as e:
                return str(e)

        answers = spark.createDataFrame([(i, outcome(given)) for i, (given, _) in enumerate(cases)], "number long, outcome string")
        asked = events.logs(spark, sf_dir).groupBy(F.pmod("id", F.lit(len(cases))).alias("number")).agg(F.count("*").alias("asked"))
        return asked.join(F.broadcast(answers), "number")


_outcomes("params_search", _SEARCHES, _found_filters)
_outcomes("params_aggregate", _AGGREGATES, _found_aggregate)
_outcomes("params_cursor", _CURSORS, _found_cursor)


# searches whose text holds signs that SQL patterns and literals give a meaning to

_ODD_SIGNS = (" 100% sure", " a_b", " c\\d", " ' OR 1=1 --")


def _odd_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, of which four in 97 have such signs at the end of their message."""
    tail = F.lit("")
    for k, sign in enumerate(_ODD_SIGNS):
        tail = F.when(F.col("id") % 97 == k, F.lit(sign)).otherwise(tail)
    return events.logs(spark, sf_dir).withColumn("message", F.concat("message", tail))


_ODD_SQL = LOGS + ", odd AS (SELECT id, timestamp, message || CASE id % 97 " + " ".join(f"WHEN {k} THEN {sql_text(s)}" for k, s in enumerate(_ODD_SIGNS)) + " ELSE '' END AS message FROM logs) "


def _literal(name: str, q: str) -> None:
    @query(name, _ODD_SQL + f"SELECT id, timestamp, message FROM odd WHERE contains(lower(message), {sql_text(q.lower())}) ORDER BY timestamp DESC, id DESC LIMIT 100")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        filters = parse_filters({"q": q})
        return search.top(_odd_logs(spark, sf_dir), filters, filters.limit).select("id", "timestamp", "message")


_literal("search_literal_percent", "100%")
_literal("search_literal_underscore", "A_B")
_literal("search_literal_backslash", "\\")
_literal("search_literal_quote", "' or 1=1 --")


@query("search_first_value", LOGS + "SELECT id, timestamp, service FROM logs WHERE service = 'svc-3' ORDER BY timestamp DESC, id DESC LIMIT 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = parse_filters([("service", "svc-3"), ("service", "svc-1"), ("limit", "25"), ("limit", "7"), ("cursor", ""), ("color", "red")])
    return search.staged(events.logs(spark, sf_dir), filters, micros_of(MONTH[1])).select("id", "timestamp", "service")


# order (O4)


@query(
    "agg_order",
    LOGS
    + f"""SELECT row_number() OVER (ORDER BY bucket_start, grp NULLS FIRST) AS place, bucket_start, grp, cnt FROM (
SELECT time_bucket(INTERVAL '1 hour', timestamp) AS bucket_start, service AS grp, count(*) AS cnt FROM logs WHERE timestamp >= {sql_time(MONTH[0])} AND timestamp < {sql_time(MONTH[1])} GROUP BY 1, 2)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = parse_aggregate({"since": MONTH[0], "until": MONTH[1], "bucket": "1h", "group_by": "service"})
    counts = aggregate.raw_counts(events.logs(spark, sf_dir), params)
    # the order that the rows come in, not their values, gives the place
    arrived = counts.withColumn("arrived", F.monotonically_increasing_id())
    return arrived.select(F.row_number().over(Window.orderBy("arrived")).cast("long").alias("place"), "bucket_start", "grp", "cnt")


# validation of what FAULTS leaves out (V1, V3, V6-V8, V10-V13), and of bodies beyond the limit

_MORE = "CASE id % 16 " + " ".join(f"WHEN {k} THEN {sql_text(r)}" for k, (r, _) in MORE_FAULTS.items()) + " END"


@query("validate_more_reasons", LOGS + f"SELECT {_MORE} AS reason, count(*) AS n FROM logs GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = validate.requests(request_bodies(spark, sf_dir, MORE_FAULTS, 16))
    return validate.validated(validate.entries(found), micros_of(MONTH[1])).groupBy("reason").agg(F.count("*").alias("n"))


@query("validate_rejected_places", LOGS + f"SELECT id // 50 AS request_id, CAST(id % 50 AS INTEGER) AS \"index\", {_MORE} AS reason FROM logs WHERE id % 16 < {len(MORE_FAULTS)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = validate.requests(request_bodies(spark, sf_dir, MORE_FAULTS, 16))
    return validate.rejected(validate.validated(validate.entries(found), micros_of(MONTH[1]))).select("request_id", "index", "reason")


@query("body_limit", LOGS + "SELECT CASE WHEN id // 50 % 100 = 0 THEN 'request body is too large' END AS refused, count(DISTINCT id // 50) AS n FROM logs GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body in a hundred is filled up to a byte beyond the limit, another one to the limit itself."""
    bodies = request_bodies(spark, sf_dir)
    size = F.when(F.col("request_id") % 100 == 0, MAX_BODY_BYTES + 1).when(F.col("request_id") % 100 == 1, MAX_BODY_BYTES).otherwise(F.octet_length("body"))
    return validate.requests(bodies.withColumn("body", F.rpad("body", size, F.lit(" ")))).groupBy("refused").agg(F.count("*").alias("n"))


# documents

_ROW_JSON = """'{"id":"' || id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || level || '","service":"' || service || '","message":"' || message
|| '","attributes":{"k":"' || k || '","user_id":"' || user_id || '","event_type":"' || event_type || '"}}'"""


def _page_sql(where: str, limit: int) -> str:
    cursor = "rtrim(replace(replace(base64(encode('{\"t\":\"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '\",\"i\":\"' || id || '\"}')), '+', '-'), '/', '_'), '=')"
    return (
        LOGS
        + f""", p AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS place, count(*) OVER () AS total FROM logs WHERE {where})
SELECT '{{"logs":[' || coalesce(string_agg({_ROW_JSON}, ',' ORDER BY place), '') || '],"next_cursor":' || coalesce('"' || max(CASE WHEN place = {limit} AND total > {limit} THEN {cursor} END) || '"', 'null') || '}}' AS value
FROM p WHERE place <= {limit}"""
    )


def _page(name: str, where: str, limit: int, **params: str) -> None:
    @query(name, _page_sql(where, limit))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        filters = parse_filters(params | {"limit": str(limit)})
        return requests.page_document(search.top(events.logs(spark, sf_dir), filters, filters.limit + 1), filters.limit)


_page("page_document", "service = 'svc-2'", 50, service="svc-2")
_page("page_document_last", "timestamp >= TIMESTAMP '2024-01-02' AND timestamp < TIMESTAMP '2024-01-02 00:20:00'", 1000, since="2024-01-02", until="2024-01-02T00:20:00Z")
_page("page_document_empty", "service = 'none'", 10, service="none")


@query(
    "buckets_document",
    LOGS
    + """SELECT '{"buckets":[' || string_agg('{"start":"' || strftime(b, '%Y-%m-%dT%H:%M:%S.%fZ') || '","group":' || CASE WHEN level IS NULL THEN 'null' ELSE '"' || level || '"' END || ',"count":' || n || '}', ',' ORDER BY b, level) || ']}' AS value
FROM (SELECT time_bucket(INTERVAL '1 day', timestamp) AS b, level, count(*) AS n FROM logs GROUP BY 1, 2)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = parse_aggregate({"since": MONTH[0], "until": MONTH[1], "bucket": "1d", "group_by": "level"})
    return requests.buckets_document(aggregate.raw_counts(events.logs(spark, sf_dir), params))


@query(
    "answers_document",
    LOGS
    + f"""SELECT '{{"accepted":' || count(*) FILTER (id % 16 >= {len(MORE_FAULTS)}) || ',"rejected":[' || coalesce(string_agg('{{"index":' || id % 50 || ',"reason":"' || {_MORE} || '"}}', ',' ORDER BY id), '') || ']}}' AS value
FROM logs GROUP BY id // 50""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    found = validate.requests(request_bodies(spark, sf_dir, MORE_FAULTS, 16))
    done = validate.answers(validate.validated(validate.entries(found), micros_of(MONTH[1])), ["request_id"])
    return requests.as_json(done.select("accepted", "rejected"))


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a served request: clicks are ingests, views are searches, the others aggregates."""
    kind = F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "view", "query").otherwise("aggregate")
    plain = F.lit(aggregate.can_use_rollup(Filters(service="a")))
    costly = F.lit(aggregate.can_use_rollup(Filters(attributes={"k": "1"})))
    number = F.col("event_id")
    return events.events(spark, sf_dir).select(
        number.alias("number"), kind.alias("kind"), F.col("value").alias("millis"), (number % 7).alias("accepted"), (number % 3).alias("rejected"),
        ((number % 50 == 0) & (kind == "ingest")).alias("failed"), F.when(number % 4 == 0, costly).otherwise(plain).alias("from_rollup"),
    )


def _ring_sql(kind: str) -> str:
    return f"(SELECT list_sort(list(value)) FROM (SELECT value FROM s WHERE kind = '{kind}' AND NOT failed ORDER BY event_id DESC LIMIT 1000))"


def _rank_sql(ring: str, p: float) -> str:
    return f"coalesce(CAST(round({ring}[least(len({ring}), CAST(floor(len({ring}) * {p}) AS INTEGER) + 1)]) AS BIGINT), 0)"


_FIGURES = {
    "uptime_seconds": "CAST(7200 AS BIGINT)",
    "ingest_requests": "(SELECT count(*) FROM s WHERE kind = 'ingest' AND NOT failed)",
    "logs_accepted": "(SELECT CAST(coalesce(sum(event_id % 7), 0) AS BIGINT) FROM s WHERE kind = 'ingest' AND NOT failed)",
    "logs_rejected": "(SELECT CAST(coalesce(sum(event_id % 3), 0) AS BIGINT) FROM s WHERE kind = 'ingest' AND NOT failed)",
    "errors": "(SELECT count(*) FROM s WHERE failed)",
    "logs_per_second": "(SELECT CAST(round(coalesce(sum(event_id % 7), 0) / 7200) AS BIGINT) FROM s WHERE kind = 'ingest' AND NOT failed)",
    "query_requests": "(SELECT count(*) FROM s WHERE kind = 'query')",
    "aggregate_requests": "(SELECT count(*) FROM s WHERE kind = 'aggregate')",
    "served_from_rollup": "(SELECT count(*) FROM s WHERE kind = 'aggregate' AND event_id % 4 <> 0)",
    "served_from_raw": "(SELECT count(*) FROM s WHERE kind = 'aggregate' AND event_id % 4 = 0)",
    "heap_used_mb": "CAST(12.3 AS DOUBLE)",
} | {f"{kind}_p{round(p * 100)}": _rank_sql(f"r.{kind}", p) for kind in metrics.KINDS for p in (0.5, 0.95, 0.99)}


@query(
    "metrics_document",
    """WITH s AS (SELECT *, CASE event_type WHEN 'click' THEN 'ingest' WHEN 'view' THEN 'query' ELSE 'aggregate' END AS kind, event_id % 50 = 0 AND event_type = 'click' AS failed FROM events),
r AS (SELECT """
    + ", ".join(f"{_ring_sql(k)} AS {k}" for k in metrics.KINDS)
    + ") SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _FIGURES.items())
    + " FROM r",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.document(_served(spark, sf_dir), 7200.0, {"heap_used_mb": 12.34})
    parts = {"ingest_requests": "ingestion.requests", "query_requests": "queries.requests", "aggregate_requests": "aggregations.requests", "heap_used_mb": "memory.heap_used_mb", "uptime_seconds": "uptime_seconds"}
    parts |= {f"served_from_{x}": f"aggregations.served_from_{x}" for x in ("rollup", "raw")} | {x: f"ingestion.{x}" for x in ("logs_accepted", "logs_rejected", "errors", "logs_per_second")}
    parts |= {f"{kind}_p{p}": f"{part}.latency_ms.p{p}" for kind, part in metrics.KINDS.items() for p in (50, 95, 99)}
    return found.select(*(F.col(path).alias(name) for name, path in parts.items()))


# the store's rules


def _entries(spark: SparkSession, sf_dir: str, batches: int = 1, batch: int = 0) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return logs.where(F.col("id") % batches == batch).select(F.col("id").alias("request"), F.lit(0).alias("index"), "timestamp", "level", "service", "message", "attributes")


@query(
    "retention_counters",
    LOGS
    + """SELECT 'rollup_1s' AS grain, date_trunc('second', timestamp) AS bucket, service, level, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24' GROUP BY ALL
UNION ALL SELECT 'rollup_1m', date_trunc('minute', timestamp), service, level, count(*) FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24' GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    store.load("bulk", events.logs(spark, sf_dir))
    store.rebuild()
    store.retain(micros_of("2024-01-31T09:30:00Z"), 7)
    seconds, minutes = (rollup.merge(store.counters(t)).withColumn("grain", F.lit(t)) for t in ("rollup_1s", "rollup_1m"))
    return seconds.unionByName(minutes).select("grain", "bucket", "service", "level", "count")


@query("store_one_committer", LOGS + "SELECT date_trunc('minute', timestamp) AS bucket, service, level, count(*) AS count, true AS refused FROM logs WHERE id % 2 = 0 GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer that began before the first was done publishes nothing."""
    store = Store(spark, scratch(spark, "store"))
    stale = store.manifest()
    store.append("b0", _entries(spark, sf_dir, 2, 0))
    try:
        store.publish(stale.with_batch("b1"))
        refused = False
    except Conflict:
        refused = True
    return rollup.merge(store.counters("rollup_1m")).withColumn("refused", F.lit(refused))


@query("store_migrated", LOGS + "SELECT date_trunc('minute', timestamp) AS bucket, service, level, count(*) AS count FROM logs GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store whose manifest is of the first format goes on as one of the present one."""
    root = scratch(spark, "store")
    Store(spark, root).append("part-0", _entries(spark, sf_dir, 2, 0))
    store = Store(spark, root)
    store.write_first_format(store.manifest())
    store.append("part-0", _entries(spark, sf_dir, 2, 0))  # known from the old manifest
    store.append("part-1", _entries(spark, sf_dir, 2, 1))
    return rollup.merge(store.counters("rollup_1m"))


@query("stream_limited", LOGS + "SELECT CAST(4 AS BIGINT) AS triggers, CAST(2 AS BIGINT) AS most, count(*) FILTER (id % 10 >= 8) AS accepted FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files of requests, two a trigger: the others wait in their folder."""
    base = scratch(spark, "stream")
    line_files(spark, sf_dir, f"{base}/in", 8)
    ingest(spark, f"{base}/in", Store(spark, f"{base}/store"), f"{base}/checkpoint", lambda: micros_of(MONTH[1]), f"{base}/answers", 2, lines=True).awaitTermination()
    answers = spark.read.option("basePath", f"{base}/answers").json(f"{base}/answers")
    answers = answers.groupBy("batch").agg(F.count_distinct(F.substring_index("request_id", "#", 1)).alias("n"), F.sum("accepted").alias("accepted"))
    return answers.agg(F.count("*").alias("triggers"), F.max("n").alias("most"), F.sum("accepted").alias("accepted"))
