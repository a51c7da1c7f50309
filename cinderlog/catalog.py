"""The queries of the log engine over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import catalog_service  # noqa: F401  registers its queries
from cinderlog.bodies import FAULTS, PER_REQUEST, body_files, request_bodies
from cinderlog.functions.buckets import day_of
from cinderlog.functions.percentiles import nearest_ranks
from cinderlog.model import Filters, Position
from cinderlog.operators import aggregate, metrics, predicates, rollup, search, validate
from cinderlog.operators.cursor import decode, encode
from cinderlog.operators.params import micros_of, parse_aggregate, parse_filters
from cinderlog.registry import DAY, LOGS, MONTH, ODD, QUERIES, SQL, WIDTHS, query, sql_text  # noqa: F401
from cinderlog.registry import sql_time as _sql_time
from cinderlog.sources import events, generator, requests
from cinderlog.sources.scratch import scratch, stored_events
from cinderlog.sources.store import Store
from cinderlog.streaming.ingest import ingest

# counts by bucket from raw rows


def _count_sql(bucket: str, span: tuple[str, str], group: str | None = None, where: str = "TRUE") -> str:
    return (
        LOGS
        + f"SELECT time_bucket(INTERVAL '{WIDTHS[bucket]}', timestamp) AS bucket_start, {group or 'CAST(NULL AS VARCHAR)'} AS grp, count(*) AS cnt FROM logs "
        + f"WHERE timestamp >= {_sql_time(span[0])} AND timestamp < {_sql_time(span[1])} AND {where} GROUP BY 1, 2"
    )


def _counts(name: str, bucket: str, span: tuple[str, str], group: str | None = None, where: str = "TRUE", **more: str) -> None:
    params = {"since": span[0], "until": span[1], "bucket": bucket} | ({"group_by": group} if group else {}) | more

    @query(name, _count_sql(bucket, span, group, where))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate.raw_counts(events.logs(spark, sf_dir), parse_aggregate(params))


for _bucket in WIDTHS:
    _counts(f"agg_raw_{_bucket}", _bucket, MONTH)
_counts("agg_group_service", "1h", MONTH, "service")
_counts("agg_group_level", "1h", MONTH, "level")
_counts("agg_filter_service", "1h", MONTH, None, "service = 'svc-3'", service="svc-3")
_counts("agg_filter_level", "1h", MONTH, None, "level = 'error'", level="error")
_counts("agg_filter_attr", "1d", MONTH, "level", "k = '7'", **{"attr.k": "7"})
_counts("agg_filter_q", "1d", MONTH, "service", "contains(lower(message), 'user 1')", q="USER 1")
_counts("agg_filter_all", "5m", ODD, "level", "service = 'svc-1' AND level = 'warn' AND k = '11' AND contains(message, 'purchase')", service="svc-1", level="warn", q="purchase", **{"attr.k": "11"})
_counts("agg_null_group", "1d", DAY)


# the same counts from stored rollups: the oracle counts raw rows, so the routing is what is tested.
# The store is set up once for a session and table, and then read


def _routed(name: str, bucket: str, span: tuple[str, str], group: str | None = None, where: str = "TRUE", guards: bool = False, second_from: str = MONTH[0], **more: str) -> None:
    params = {"since": span[0], "until": span[1], "bucket": bucket} | ({"group_by": group} if group else {}) | more

    @query(name, _count_sql(bucket, span, group, where))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = stored_events(spark, sf_dir)
        logs, seconds, minutes = store.logs(), store.counters("rollup_1s"), store.counters("rollup_1m")
        parsed = parse_aggregate(params)
        if not aggregate.can_use_rollup(parsed.filters):
            return aggregate.aggregate(logs, seconds, minutes, parsed)
        return aggregate.rollup_counts(logs, seconds, minutes, parsed, micros_of(second_from), guards)


_routed("agg_rollup_whole", "1h", MONTH, "service")
_routed("agg_rollup_partial", "1m", ODD, "level")
_routed("agg_rollup_filtered", "1d", ODD, "service", "level = 'info'", level="info")
_routed("agg_rollup_subsecond", "1m", ("2024-01-05T10:00:10.5Z", "2024-01-05T10:20:11.2Z"))
_routed("agg_rollup_single_minute", "1m", ("2024-01-01T00:00:07.100Z", "2024-01-01T00:00:07.900Z"), "service")
_routed("agg_rollup_guarded", "1h", ODD, "level", guards=True)
_routed("agg_rollup_watermark", "5m", ODD, "service", second_from="2024-01-15T00:00:00Z")
_routed("agg_router_raw", "1d", ODD, "level", "k = '3'", **{"attr.k": "3"})

_SECOND = LOGS + "SELECT date_trunc('second', timestamp) AS bucket, service, level, count(*) AS count FROM logs GROUP BY ALL"
_MINUTE = LOGS + "SELECT date_trunc('minute', timestamp) AS bucket, service, level, count(*) AS count FROM logs GROUP BY ALL"


@query("rollup_1s", _SECOND)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_second(events.logs(spark, sf_dir))


@query("rollup_1m", _MINUTE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.by_minute(events.logs(spark, sf_dir))


@query("rollup_fold", _MINUTE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fold(rollup.by_second(events.logs(spark, sf_dir)))


@query("rollup_incremental_merge", _MINUTE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return rollup.merge(*(rollup.by_minute(logs.where(F.pmod("id", F.lit(4)) == k)) for k in range(4)))


@query(
    "rollup_reconcile",
    LOGS
    + f"""SELECT date_trunc('minute', timestamp) AS bucket, service, level, count(*) AS count FROM logs
WHERE id % 2 = 0 OR (timestamp >= {_sql_time(DAY[0])} AND timestamp < {_sql_time(DAY[1])}) GROUP BY ALL""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return rollup.reconcile(rollup.by_minute(logs.where("id % 2 = 0")), logs, micros_of(DAY[0]), micros_of(DAY[1]))


@query("rollup_drift", LOGS + "SELECT count(*) FILTER (id % 2 = 1) AS drift FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return rollup.net_drift(rollup.by_minute(logs.where("id % 2 = 0")), logs)


@query(
    "rollup_bucket_drift",
    LOGS
    + """SELECT date_trunc('minute', timestamp) AS bucket, service, level, count(*) FILTER (id % 3 = 0) AS stored, count(*) AS actual FROM logs
GROUP BY ALL HAVING count(*) <> count(*) FILTER (id % 3 = 0)""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return rollup.bucket_drift(rollup.by_minute(logs.where("id % 3 = 0")), logs)


# search (O1-O3, O6, P1-P8)

_SHOWN = "id, timestamp, level, service, message, k, user_id, event_type"


def _flat(rows: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return rows.select("id", "timestamp", "level", "service", "message", a["k"].alias("k"), a["user_id"].alias("user_id"), a["event_type"].alias("event_type"))


def _search_sql(where: str = "TRUE", limit: int = 100, more: str = "") -> str:
    return LOGS + f"SELECT {_SHOWN} FROM logs WHERE {where} ORDER BY timestamp DESC, id DESC LIMIT {limit} {more}"


def _search(name: str, where: str, rows: int = 100, **params: str) -> None:
    @query(name, _search_sql(where, rows))
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        filters = parse_filters(params)
        return _flat(search.top(events.logs(spark, sf_dir), filters, filters.limit))


_search("search_default", "TRUE")
_search("search_service_level", "service = 'svc-2' AND level = 'error'", 50, service="svc-2", level="error", limit="50")
_search("search_range", f"timestamp >= {_sql_time(ODD[0])} AND timestamp < {_sql_time(ODD[1])}", 200, since=ODD[0], until=ODD[1], limit="200")
_search("search_attr", "k = '42' AND event_type = 'click'", 1000, **{"attr.k": "42", "attr.event_type": "click", "limit": "1e3"})
_search("search_q", "contains(lower(message), 'error by user 14')", 500, q="Error By User 14", limit="500")


@query("search_page2", _search_sql(limit=100, more="OFFSET 100"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs, filters = events.logs(spark, sf_dir), Filters()
    first = search.search(logs, filters, micros_of(MONTH[1]))
    return _flat(search.top(logs, filters, filters.limit, decode(first.next_cursor)))


@query("search_all_pages", LOGS + "SELECT (row_number() OVER (ORDER BY timestamp DESC, id DESC) - 1) // 1000 AS page, id, timestamp FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.all_pages(events.logs(spark, sf_dir), parse_filters({"limit": "1000"})).select("page", "id", "timestamp")


@query("search_staged", _search_sql("k = '5'", 20))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(search.staged(events.logs(spark, sf_dir), parse_filters({"attr.k": "5", "limit": "20"}), micros_of(MONTH[1])))


@query("search_keyset", LOGS + "SELECT id, timestamp FROM logs WHERE (timestamp, id) < (TIMESTAMP '2024-01-15 12:00:00', 500)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    cursor = encode(Position(micros_of("2024-01-15T12:00:00Z"), 500))
    return events.logs(spark, sf_dir).where(predicates.before(decode(cursor))).select("id", "timestamp")


# validation of raw requests

def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return validate.validated(validate.entries(validate.requests(request_bodies(spark, sf_dir))), micros_of(MONTH[1]))


_REASON = "CASE id % 10 " + " ".join(f"WHEN {k} THEN '{r.replace(chr(39), chr(39) * 2)}'" for k, (r, _) in FAULTS.items()) + " END"


@query("validate_reasons", LOGS + f"SELECT {_REASON} AS reason, count(*) AS n FROM logs GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "validate_accepted",
    LOGS
    + """SELECT date_trunc('millisecond', timestamp) AS timestamp, level, service, message, k, user_id AS "user", CASE WHEN id % 2 = 1 THEN 'true' ELSE 'false' END AS odd
FROM logs WHERE id % 10 >= 8""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("attributes")
    return validate.accepted(_checked(spark, sf_dir)).select("timestamp", "level", "service", "message", a["k"].alias("k"), a["user"].alias("user"), a["odd"].alias("odd"))


@query(
    "validate_answers",
    LOGS
    + f"""SELECT id // {PER_REQUEST} AS request_id, count(*) FILTER (id % 10 >= 8) AS accepted, CAST(count(*) FILTER (id % 10 < 8) AS INTEGER) AS rejected,
CASE WHEN count(*) FILTER (id % 10 >= 8) > 0 THEN 200 ELSE 400 END AS status FROM logs GROUP BY 1""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.answers(_checked(spark, sf_dir), ["request_id"]).select("request_id", "accepted", F.size("rejected").alias("rejected"), "status")


#: Envelopes, each with the reason why the whole request is refused.
_ENVELOPES = [
    ('{"logs": [', "request body is not valid JSON"),
    ("[1, 2]", "request body must be an object"),
    ('{"log": []}', "missing required field: logs"),
    ('{"logs": {"a": 1}}', "logs must be an array"),
    ('{"logs": []}', "logs must not be empty"),
    ('{"logs": [1]}', None),
]


@query("validate_envelopes", "SELECT * FROM (VALUES " + ", ".join(f"('{b}', {'NULL' if r is None else chr(39) + r + chr(39)})" for b, r in _ENVELOPES) + ") AS t(body, refused)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.requests(spark.createDataFrame([(b,) for b, _ in _ENVELOPES], "body string")).select("body", "refused")


#: JSON numbers with the text that is stored.
_NUMBERS = [("3", "3"), ("3.0", "3"), ("1e3", "1000"), ("1e21", "1e+21"), ("1e-7", "1e-7"), ("0.000001", "0.000001"), ("-0", "0"), ("9007199254740993", "9007199254740992"), ("0.1", "0.1"), ("123456.789", "123456.789"), ("-2.50", "-2.5"), ("true", "true")]


@query("attr_coercion", "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _NUMBERS) + ") AS t(given, stored)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(n, f'{{"logs": [{{"timestamp": "2024-01-01", "level": "info", "service": "s", "message": "m", "attributes": {{"x": {n}}}}}]}}') for n, _ in _NUMBERS], "given string, body string")
    checked = validate.validated(validate.entries(validate.requests(given)), micros_of(MONTH[1]))
    return validate.accepted(checked).select("given", F.col("attributes")["x"].alias("stored"))


# series and operational figures

_HOUR_END = "2024-01-10T13:00:30Z"
_SERIES = (
    LOGS
    + """, s AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-10 12:00:00', TIMESTAMP '2024-01-10 12:59:00', INTERVAL 1 MINUTE)) AS minute),
c AS (SELECT minute, count(id) AS cnt FROM s LEFT JOIN logs ON date_trunc('minute', timestamp) = minute GROUP BY 1) """
)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = micros_of(_HOUR_END)
    params = parse_aggregate({"since": "2024-01-10T12:00:00Z", "until": _HOUR_END, "bucket": "1m"})
    return metrics.minute_series(aggregate.raw_counts(events.logs(spark, sf_dir), params), end)


@query("gap_fill_hour", _SERIES + "SELECT minute, cnt FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir)


@query("peak_normalised", _SERIES + "SELECT minute, cnt, CAST(round(cnt / greatest(1, max(cnt) OVER ()) * 100) AS BIGINT) AS percent FROM c")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.normalised(_series(spark, sf_dir))


@query(
    "percentile_ring",
    """WITH r AS (SELECT list_sort(list(value)) AS v FROM (SELECT value FROM events ORDER BY event_id DESC LIMIT 1000))
SELECT CAST(round(v[least(len(v), CAST(floor(len(v) * 0.5) AS INTEGER) + 1)]) AS BIGINT) AS p50, CAST(round(v[least(len(v), CAST(floor(len(v) * 0.95) AS INTEGER) + 1)]) AS BIGINT) AS p95,
CAST(round(v[least(len(v), CAST(floor(len(v) * 0.99) AS INTEGER) + 1)]) AS BIGINT) AS p99 FROM r""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ring_summary(events.events(spark, sf_dir), "value", "event_id")


@query("percentile_nearest_rank", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_ranks(events.events(spark, sf_dir), "event_type", "value", (0.5, 0.95, 0.99))


@query(
    "ingest_counters",
    f"""SELECT CAST(count(*) FILTER (event_id % 10 >= 8) AS BIGINT) AS accepted, CAST(count(*) FILTER (event_id % 10 < 8) AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS failures,
CAST(round(count(*) FILTER (event_id % 10 >= 8) / 3600) AS BIGINT) AS rate FROM events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = validate.answers(_checked(spark, sf_dir), ["request_id"])
    return metrics.snapshot(done.select("accepted", F.size("rejected").cast("long").alias("rejected"), (F.col("status") >= 500).alias("failed")), F.lit(3600))


@query(
    "metrics_json",
    f"""SELECT '{{"accepted":' || count(*) FILTER (event_id % 10 >= 8) || ',"rejected":' || count(*) FILTER (event_id % 10 < 8) || ',"failures":0,"rate":'
|| CAST(round(count(*) FILTER (event_id % 10 >= 8) / 3600) AS BIGINT) || '}}' AS value FROM events""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = validate.answers(_checked(spark, sf_dir), ["request_id"])
    counted = done.select("accepted", F.size("rejected").cast("long").alias("rejected"), (F.col("status") >= 500).alias("failed"))
    return requests.as_json(metrics.snapshot(counted, F.lit(3600)))


@query(
    "buckets_json",
    LOGS
    + """SELECT '{"start":"' || strftime(time_bucket(INTERVAL '1 day', timestamp), '%Y-%m-%dT%H:%M:%S.%fZ') || '","group":"' || level || '","count":' || count(*) || '}' AS value
FROM logs GROUP BY time_bucket(INTERVAL '1 day', timestamp), level""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = parse_aggregate({"since": MONTH[0], "until": MONTH[1], "bucket": "1d", "group_by": "level"})
    counts = aggregate.raw_counts(events.logs(spark, sf_dir), params)
    return requests.as_json(counts.select(F.col("bucket_start").alias("start"), F.col("grp").alias("group"), F.col("cnt").alias("count")))


@query(
    "page_json",
    LOGS
    + """SELECT '{"id":"' || id || '","timestamp":"' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '","level":"' || level || '","service":"' || service || '","message":"' || message
|| '","attributes":{"k":"' || k || '","user_id":"' || user_id || '","event_type":"' || event_type || '"}}' AS value FROM logs ORDER BY timestamp DESC, id DESC LIMIT 100""",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.as_json(search.top(events.logs(spark, sf_dir), Filters(), 100))


@query("bucket_day", LOGS + "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM logs GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.logs(spark, sf_dir).groupBy(day_of(F.col("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("rows"))


# the store and the stream

_TODAY = "2024-01-31T09:30:00Z"


def _entries(spark: SparkSession, sf_dir: str, batches: int = 1, batch: int = 0) -> DataFrame:
    logs = events.logs(spark, sf_dir)
    return logs.where(F.col("id") % batches == batch).select(F.col("id").alias("request"), F.lit(0).alias("index"), "timestamp", "level", "service", "message", "attributes")


@query("store_append", LOGS + "SELECT timestamp, level, service, message, k FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    for k in range(2):
        store.append(f"b{k}", _entries(spark, sf_dir, 2, k))
    store.append("b1", _entries(spark, sf_dir, 2, 1))  # a repeated batch is not taken twice
    return store.logs().select("timestamp", "level", "service", "message", F.col("attributes")["k"].alias("k"))


@query("store_counters", _MINUTE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    for k in range(2):
        store.append(f"b{k}", _entries(spark, sf_dir, 2, k))
    store.compact()
    return rollup.merge(store.counters("rollup_1m"))


@query("store_rebuild", _SECOND)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    store.load("bulk", events.logs(spark, sf_dir))
    store.repair()
    return rollup.merge(store.counters("rollup_1s"))


@query("retention_keep", LOGS + "SELECT id, timestamp FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    store.load("bulk", events.logs(spark, sf_dir))
    store.retain(micros_of(_TODAY), 7)
    return store.logs().select("id", "timestamp")


@query("second_window", LOGS + "SELECT date_trunc('second', timestamp) AS bucket, service, level, count(*) AS count FROM logs WHERE timestamp >= TIMESTAMP '2024-01-30 09:30:00' GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    store.load("bulk", events.logs(spark, sf_dir))
    store.rebuild()
    store.prune_seconds(micros_of(_TODAY), 24 * 60)
    return rollup.merge(store.counters("rollup_1s"))


@query("stream_rollup", LOGS + "SELECT date_trunc('minute', date_trunc('millisecond', timestamp)) AS bucket, service, level, count(*) AS count FROM logs WHERE id % 10 >= 8 GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "stream")
    store = Store(spark, f"{base}/store")
    body_files(spark, sf_dir, f"{base}/in")
    ingest(spark, f"{base}/in", store, f"{base}/checkpoint", lambda: micros_of(MONTH[1])).awaitTermination()
    return rollup.merge(store.counters("rollup_1m"))


@query("generator", generator.sql(1_000_000, micros_of(MONTH[1])) + "SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, level, service, region, count(*) AS n, min(id) AS first_id, max(timestamp) AS last FROM made GROUP BY 1, 2, 3, 4")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = generator.generate(spark, 1_000_000, micros_of(MONTH[1]))
    return made.groupBy(day_of(F.col("timestamp")).cast("string").alias("day"), "level", "service", F.col("attributes")["region"].alias("region")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("timestamp").alias("last"))


@query("bulk_load_round_trip", LOGS + "SELECT id, message || chr(10) || chr(9) || '\\' AS message FROM logs")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, scratch(spark, "store"))
    store.load("bulk", events.logs(spark, sf_dir).withColumn("message", F.concat("message", F.lit("\n\t\\"))))
    return store.logs().select("id", "message")


