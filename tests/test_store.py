import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cinderlog.model import MINUTE
from cinderlog.operators import rollup
from cinderlog.operators.params import micros_of
from cinderlog.sources.requests import as_json
from cinderlog.sources.store import Conflict, Store
from cinderlog.streaming.ingest import ingest

NOW = micros_of("2026-08-12T12:00:00Z")
DAY = 86_400_000_000
ENTRY = "request long, index int, timestamp timestamp, level string, service string, message string, attributes map<string,string>"


def when(micros):
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros)


def entries(spark, n, start=NOW, step=MINUTE // 3, first=0):
    return spark.createDataFrame([(first + i // 10, i % 10, when(start + i * step), "info" if i % 2 else "error", f"s{i % 3}", f"m{i}", {"i": str(i)}) for i in range(n)], ENTRY)


def drift(store):
    logs = store.logs()
    return rollup.bucket_drift(store.counters("rollup_1s"), logs, "second").count() + rollup.bucket_drift(store.counters("rollup_1m"), logs).count()


def test_append_is_atomic_and_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.logs().count() == 0 and store.counters("rollup_1m").count() == 0
    store.append("a", entries(spark, 35))
    before = store.manifest()
    store.append("a", entries(spark, 35))
    store.append("b", entries(spark, 12, NOW - 400 * DAY))  # rows of any age count
    store.append("none", entries(spark, 0))
    assert store.logs().count() == 47 and drift(store) == 0
    # a reader of the older manifest sees its own moment
    assert store.logs(before).count() == 35 and store.counters("rollup_1m", before).agg(F.sum("count")).first()[0] == 35
    ids = [r["id"] for r in store.logs().select("id").collect()]
    assert len(set(ids)) == 47
    by_arrival = [r["message"] for r in store.logs(before).orderBy("id").collect()]
    assert by_arrival == [f"m{i}" for i in range(35)]


def test_failure_between_rows_and_counters_shows_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    real = rollup.by_second
    monkeypatch.setattr(rollup, "by_second", lambda _: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.append("a", entries(spark, 5))
    assert store.logs().count() == 0
    monkeypatch.setattr(rollup, "by_second", real)
    store.append("a", entries(spark, 5))
    assert store.logs().count() == 5 and drift(store) == 0


def test_one_committer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    stale = store.manifest()
    store.append("a", entries(spark, 3))
    with pytest.raises(Conflict):
        store.publish(stale)


def test_manifests_hold_changes(spark, tmp_path, monkeypatch):
    from cinderlog.sources import store as module

    monkeypatch.setattr(module, "WHOLE", 4)
    monkeypatch.setattr(module, "COMPACT_COUNTERS", 5)
    monkeypatch.setattr(module, "COMPACT_LOGS", 6)
    store, seen = Store(spark, str(tmp_path)), {}
    for k in range(9):
        seen[k] = store.append(f"b-{k}", entries(spark, 5, first=10 * k))
        assert store.manifest() == seen[k]
        assert store.append(f"b-{k}", entries(spark, 5)) == seen[k]
    assert store.manifest(seen[2].version) == seen[2] and store.manifest().marks == {"b": 8}
    assert store.logs().count() == 45 and drift(store) == 0
    assert len(store.manifest().folders["logs"]) < 6 and len(store.manifest().folders["rollup_1m"]) < 5
    store.vacuum(1)
    assert store.manifest() == seen[8] and store.logs().count() == 45
    with pytest.raises(Conflict):
        store.publish(seen[7])


def test_manifest_of_the_first_format(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("a", entries(spark, 5))
    store.append("s-0", entries(spark, 5, first=10))
    store.write_first_format(store.manifest())
    again = Store(spark, str(tmp_path))
    assert again.manifest().batches == ["a"] and again.manifest().marks == {"s": 0}
    again.append("s-0", entries(spark, 5))
    again.append("s-1", entries(spark, 5, first=20))
    assert again.logs().count() == 15 and drift(again) == 0


def test_repair_reconcile_compact(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("a", entries(spark, 30))
    extra = entries(spark, 20).select((F.col("request") * 10 + F.col("index") + 1000).alias("id"), "timestamp", "level", "service", "message", "attributes")
    store.load("bulk", extra)
    assert drift(store) > 0
    store.reconcile(NOW, NOW + 60 * MINUTE)
    assert drift(store) == 0
    store.load("bulk2", extra.withColumn("id", F.col("id") + 1000))
    assert not store.repair().isEmpty() or drift(store) == 0
    assert drift(store) == 0
    store.append("c", entries(spark, 10, first=5))
    store.compact()
    assert drift(store) == 0 and len(store.manifest().folders["rollup_1m"]) == 1


def test_compaction_of_rows_and_vacuum(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for k in range(4):
        store.append(f"b{k}", entries(spark, 10, first=10 * k))
    before, rows = store.manifest(), sorted(store.logs().drop("attributes").collect())
    store.compact_logs(3)
    assert len(store.manifest().folders["logs"]) == 2
    assert sorted(store.logs().drop("attributes").collect()) == rows == sorted(store.logs(before).drop("attributes").collect())
    store.append("b1", entries(spark, 10))  # still known
    store.compact()
    assert store.logs().count() == 40 and drift(store) == 0
    gone = store.vacuum(1)
    assert len(gone) == 3 + 8 and store.logs().count() == 40 and drift(store) == 0
    assert store.vacuum(1) == []


def test_retention_takes_rows_and_counters_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("a", entries(spark, 40, NOW - 20 * DAY, DAY // 2))
    with pytest.raises(ValueError):
        store.retain(NOW, 0)
    _, days = store.retain(NOW, 7)
    assert days and days[-1] == "2026-08-04"
    assert store.logs().count() == 40 - 25 and drift(store) == 0
    store.prune_seconds(NOW, 120)
    at = store.manifest().second_from
    store.prune_seconds(NOW - DAY, 120)
    assert store.manifest().second_from == at == NOW - 120 * MINUTE


def test_day_partitions_are_pruned(spark, tmp_path):
    from cinderlog.operators.params import parse_filters
    from cinderlog.operators.predicates import apply

    store = Store(spark, str(tmp_path))
    store.append("a", entries(spark, 40, NOW - 20 * DAY, DAY // 2))
    plan = apply(store.logs(), parse_filters({"since": "2026-08-01T00:00:00Z", "until": "2026-08-02T00:00:00Z"}))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def body(i):
    entry = {"timestamp": "2026-08-12T11:00:00Z", "level": "info", "service": "s", "message": f"m{i}"}
    return json.dumps({"logs": [entry, entry | {"level": "bad"}, entry | {"timestamp": "2020-01-01T00:00:00Z"}]})


def test_stream(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    for i in range(5):
        (source / f"{i}.json").write_text(body(i))
    run = lambda: ingest(spark, str(source), store, str(tmp_path / "checkpoint"), lambda: NOW, str(tmp_path / "answers"), 2).awaitTermination()
    run()
    assert store.logs().count() == 10 and drift(store) == 0
    assert store.manifest().marks == {"stream": 2}
    run()
    assert store.logs().count() == 10
    (source / "late.json").write_text(body(9))
    (source / "bad.json").write_text("{")
    run()
    assert store.logs().count() == 12 and drift(store) == 0
    assert sum(r["accepted"] for r in spark.read.json(str(tmp_path / "answers")).collect()) == 12


def test_stream_of_lines(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    for name, requests in (("a", [body(1), "{", body(1), body(2)]), ("b", [body(3)])):
        (source / name).write_text("\n".join(requests))
    ingest(spark, str(source), store, str(tmp_path / "checkpoint"), lambda: NOW, str(tmp_path / "answers"), lines=True).awaitTermination()
    rows = store.logs().orderBy("id").collect()
    assert [r["message"] for r in rows] == ["m1", "m1"] * 2 + ["m2"] * 2 + ["m3"] * 2 and len({r["id"] for r in rows}) == 8
    answers = {r["request_id"].rpartition("/")[2]: r["accepted"] for r in spark.read.json(str(tmp_path / "answers")).collect()}
    assert answers == {"a#0": 2, "a#2": 2, "a#3": 2, "b#0": 2}


def test_replayed_trigger_commits_once(spark, tmp_path):
    source, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    source.mkdir()
    (source / "a.json").write_text(body(1))
    ingest(spark, str(source), store, str(tmp_path / "checkpoint"), lambda: NOW).awaitTermination()
    for f in (tmp_path / "checkpoint" / "commits").iterdir():
        f.unlink()
    ingest(spark, str(source), store, str(tmp_path / "checkpoint"), lambda: NOW).awaitTermination()
    assert store.logs().count() == 2 and drift(store) == 0


def test_json_round_trip(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    text = "a\\b\nc\td\re \"q\" \x01"
    store.append("a", entries(spark, 1).withColumn("message", F.lit(text)))
    shown = json.loads(as_json(store.logs().drop("day")).first()["value"])
    assert shown["message"] == text and shown["id"] == "1" and shown["timestamp"].startswith("2026-08-12T12:00:00.000000")
