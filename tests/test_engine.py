import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.numbers import js_text
from cinderlog.model import LOGS, MICRO, MINUTE, Filters
from cinderlog.operators import aggregate, metrics, rollup, search
from cinderlog.operators.params import iso_of, micros_of, parse_aggregate, parse_filters
from cinderlog.operators.predicates import apply
from cinderlog.sources import generator

BASE = micros_of("2026-08-12T11:00:00Z")


def when(micros):
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOGS)


@pytest.fixture(scope="module")
def few(spark):
    """25 rows, one a minute."""
    return frame(spark, [(i, when(BASE + i * MINUTE), "error" if i % 5 == 0 else "info", "api", f"query test message {i}", {"user_id": str(i % 3), "region": "eu-west"}) for i in range(25)]).cache()


@pytest.fixture(scope="module")
def dense(spark):
    """Rows every 50 ms for three minutes, with holes of whole seconds and parts of seconds."""
    r, rows = random.Random(2), []
    for k in range(3600):
        t = k * 50_000 + r.randrange(0, 50_000)
        if (t // MICRO) % 7 == 3 or t % MICRO > 900_000:
            continue
        rows.append((k, when(BASE + t), r.choice(["debug", "info", "warn", "error"]), r.choice(["a", "b"]), "m", {}))
    return frame(spark, rows).cache()


def ids(df):
    return [r["id"] for r in df.orderBy(F.desc("timestamp"), F.desc("id")).collect()]


def test_filters(few):
    assert ids(apply(few, parse_filters({"level": "error"}))) == [20, 15, 10, 5, 0]
    assert ids(apply(few, parse_filters({"attr.user_id": "1", "attr.region": "eu-west"}))) == [22, 19, 16, 13, 10, 7, 4, 1]
    assert ids(apply(few, parse_filters({"q": "MESSAGE 2"}))) == [24, 23, 22, 21, 20, 2]
    for literal in ("%", "_", "\\", "a_b"):
        assert ids(apply(few, Filters(q=literal))) == []
    assert ids(apply(few, parse_filters({"service": "api'; DROP TABLE logs; --"}))) == []
    assert ids(apply(few, Filters(q="a\x00b"))) == []
    since, until = iso_of(BASE + 3 * MINUTE), iso_of(BASE + 6 * MINUTE)
    assert ids(apply(few, parse_filters({"since": since, "until": until}))) == [5, 4, 3]
    assert ids(apply(few, parse_filters({"attr.missing": ""}))) == []


def test_pages_are_one_sort(few):
    found = list(search.pages(few, Filters(limit=7), BASE + 60 * MINUTE))
    assert [len(p.rows) for p in found] == [7, 7, 7, 4]
    assert [r["id"] for p in found for r in p.rows] == list(range(24, -1, -1))
    assert [p.has_more for p in found] == [True, True, True, False]


def test_pages_with_equal_and_microsecond_times(spark):
    rows = [(i, when(BASE + (i // 4)), "info", "s", "m", {}) for i in range(50)]
    found = [r["id"] for p in search.pages(frame(spark, rows), Filters(limit=3), BASE) for r in p.rows]
    assert found == list(range(49, -1, -1))


def test_stages_do_not_change_the_answer(spark):
    rows = [(i, when(BASE - i * 40 * MINUTE), "info", "s", "hit" if i % 2 else "miss", {}) for i in range(60)]
    logs = frame(spark, rows)
    for limit in (1, 5, 20, 40):
        f = Filters(q="hit", limit=limit)
        staged = [r["id"] for r in search.search(logs, f, BASE).rows]
        assert staged == [r["id"] for r in search.top(logs, f, limit).collect()]
    assert len(search.windows(Filters(q="x"), None, BASE)) == 3
    assert len(search.windows(Filters(q="x", since=BASE - MINUTE), None, BASE)) == 1


def test_topk_is_planned_and_filters_are_pushed(spark, few, tmp_path):
    few.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    plan = search.top(stored, parse_filters({"service": "api", "since": iso_of(BASE)}), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "EqualTo(service,api)" in plan and "GreaterThanOrEqual(timestamp" in plan


@pytest.mark.parametrize("guards", [False, True])
def test_rollup_equals_raw(dense, guards):
    seconds = rollup.by_second(dense).cache()
    minutes = rollup.fold(seconds).cache()
    r = random.Random(3)
    for k in range(10):
        since = BASE + r.randrange(-MINUTE, 3 * MINUTE, 1000)
        until = since + r.choice([700_000, 1_600_000, 30 * MICRO, MINUTE, 2 * MINUTE]) + r.randrange(0, MICRO, 1000)
        params = parse_aggregate({"since": iso_of(since), "until": iso_of(until), "bucket": r.choice(["1m", "5m", "1h"])} | ({"group_by": r.choice(["service", "level"])} if k % 3 else {}) | ({"level": "warn"} if k % 4 == 0 else {}))
        second_from = r.choice([BASE - 10 * MINUTE, BASE + MINUTE, 2**62])
        raw = aggregate.raw_counts(dense, params).collect()
        assert aggregate.rollup_counts(dense, seconds, minutes, params, second_from, guards).collect() == raw


def test_short_range_over_a_second(spark):
    logs = frame(spark, [(1, when(BASE + 10_600_000), "info", "s", "m", {}), (2, when(BASE + 11_100_000), "info", "s", "m", {})])
    seconds = rollup.by_second(logs)
    params = parse_aggregate({"since": iso_of(BASE + 10_500_000), "until": iso_of(BASE + 11_200_000), "bucket": "1m"})
    for guards in (False, True):
        assert [r["cnt"] for r in aggregate.rollup_counts(logs, seconds, rollup.fold(seconds), params, 0, guards).collect()] == [2]


def test_totals_do_not_depend_on_the_bucket(dense):
    for bucket in ("1m", "5m", "1h", "1d"):
        params = parse_aggregate({"since": iso_of(BASE), "until": iso_of(BASE + 10 * MINUTE), "bucket": bucket})
        rows = aggregate.raw_counts(dense, params).collect()
        assert sum(r["cnt"] for r in rows) == dense.count()
        assert all(r["grp"] is None for r in rows)


def test_router(few):
    seconds = rollup.by_second(few)
    for more, total in (({"attr.user_id": "1"}, 8), ({"q": "message 2"}, 6), ({"level": "error"}, 5)):
        params = parse_aggregate({"since": iso_of(BASE), "until": iso_of(BASE + 30 * MINUTE), "bucket": "1h"} | more)
        assert aggregate.can_use_rollup(params.filters) == ("level" in more)
        assert sum(r["cnt"] for r in aggregate.aggregate(few, seconds, rollup.fold(seconds), params).collect()) == total


def test_buckets_before_1970(spark):
    logs = frame(spark, [(1, when(-1), "info", "s", "m", {}), (2, when(-301 * MICRO), "info", "s", "m", {})])
    params = parse_aggregate({"since": "1969-12-31T00:00:00Z", "until": "1970-01-01T00:00:00Z", "bucket": "5m"})
    starts = [int(r["m"]) for r in aggregate.raw_counts(logs, params).select(F.unix_micros("bucket_start").alias("m")).collect()]
    assert sorted(starts) == [-600 * MICRO, -300 * MICRO]


def test_drift_and_reconcile(dense):
    good = rollup.by_minute(dense)
    bad = good.withColumn("count", F.when(F.col("level") == "warn", F.col("count") + 1).otherwise(F.col("count")))
    assert rollup.bucket_drift(good, dense).count() == 0
    wrong = rollup.bucket_drift(bad, dense).collect()
    assert wrong and all(r["stored"] == r["actual"] + 1 and r["level"] == "warn" for r in wrong)
    assert rollup.net_drift(bad, dense).first()["drift"] == -len(wrong)
    assert rollup.bucket_drift(rollup.reconcile(bad, dense, BASE, BASE + 10 * MINUTE), dense).count() == 0


def test_percentiles(spark):
    ring = spark.createDataFrame([(i, float(i)) for i in range(100)], "n int, v double")
    assert metrics.ring_summary(ring, "v", "n").first().asDict() == {"p50": 50, "p95": 95, "p99": 99}
    assert metrics.ring_summary(ring.where("n < 0"), "v", "n").first().asDict() == {"p50": 0, "p95": 0, "p99": 0}


@pytest.mark.parametrize(
    ("x", "text"),
    [(3.0, "3"), (1e3, "1000"), (1e21, "1e+21"), (1e20, "1" + "0" * 20), (1e-7, "1e-7"), (1e-6, "0.000001"), (-0.0, "0"), (0.1, "0.1"), (-2.5, "-2.5"), (1.5e-10, "1.5e-10"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (9007199254740993.0, "9007199254740992")],
)
def test_js_numbers(x, text):
    assert js_text(x) == text


def test_generator(spark):
    a = generator.generate(spark, 1000, BASE, partitions=2)
    b = generator.generate(spark, 1000, BASE, partitions=5)
    assert a.exceptAll(b.select(a.columns)).count() == 0 if not any(t.startswith("map") for _, t in a.dtypes) else a.drop("attributes").exceptAll(b.drop("attributes")).count() == 0
    share = a.groupBy("level").count().collect()
    assert {r["level"] for r in share} == {"debug", "info", "warn", "error"}
    assert max(share, key=lambda r: r["count"])["level"] == "info"


def test_numbers_in_the_jvm_are_those_of_the_plain_version(spark):
    import struct

    from cinderlog.functions.numbers import js_column

    r = random.Random(6)
    values = [struct.unpack("<d", r.randbytes(8))[0] for _ in range(20_000)] + [r.uniform(-1000, 1000) for _ in range(10_000)] + [round(r.uniform(-1e6, 1e6), r.randint(0, 9)) for _ in range(10_000)]
    values += [x * 10.0**k for k in range(-12, 24) for x in (1, -2.5, 1.25, 9.99, 123456789)] + [5e-324, 1.7976931348623157e308, 2e-3, 2.0**-44, 2e23, 0.0, -0.0, 2.0**53, 2.0**53 + 2]
    values = [x for x in values if x == x and abs(x) != float("inf")]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double").select("i", "x", js_column(F.col("x")).alias("t")).collect()
    assert [(r["x"], r["t"]) for r in rows if r["t"] != js_text(r["x"])] == []
    plan = spark.range(1).select(js_column(F.col("id").cast("double")))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_nearest_ranks_with_many_ranges(spark):
    from cinderlog.functions.percentiles import nearest_rank, nearest_ranks

    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), float(r.choice([r.randint(0, 30), r.uniform(0, 1000)]))) for _ in range(3000)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {x["g"]: tuple(x)[1:] for x in df.where("v is not null").groupBy("g").agg(*(nearest_rank("v", p).alias(f"p{round(p * 100)}") for p in (0.1, 0.5, 0.95, 0.99))).collect()}
    for ranges in (2, 16, 256):
        assert {x["g"]: tuple(x)[1:] for x in nearest_ranks(df, "g", "v", (0.1, 0.5, 0.95, 0.99), ranges).collect()} == want


def test_all_pages_are_those_that_cursors_give(few):
    filters = parse_filters({"level": "info", "limit": "4"})
    want = [(k, row["id"]) for k, page in enumerate(search.pages(few, filters, BASE + 60 * MINUTE)) for row in page.rows]
    assert sorted((r["page"], -r["id"]) for r in search.all_pages(few, filters).collect()) == sorted((k, -i) for k, i in want)
    assert ids(search.staged(few, parse_filters({"q": "message", "limit": "3"}), BASE + 60 * MINUTE)) == [24, 23, 22]
