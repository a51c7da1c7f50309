import zlib
from collections import Counter

import pytest
from tests.llm.helpers import ODD_TEXTS, clashing, docs_frame
from pyspark.sql import functions as F

from cinderlog.llm import sharding as S


@pytest.fixture(scope="module")
def placed(spark):
    return S.assign(docs_frame(spark, [f"t{i}" * (i % 7) for i in range(4000)])).collect()


def test_columns(placed):
    for r in placed:
        text = f"t{r['doc_id']}" * (r["doc_id"] % 7)
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text) + 16, zlib.crc32(text.encode()), "key")
    assert {r["shard"] for r in placed} == set(range(40))
    assert max(Counter(r["shard"] for r in placed).values()) < 160


def test_slots_have_no_gaps(placed, spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", 10)  # several buckets a shard
    for rows in (placed, S.assign(docs_frame(spark, ["t"] * 3000)).collect()):
        for shard in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


def test_growth_moves_rows_into_the_new_shard_only(placed):
    moved = [r for r in placed if r["shard"] != r["grown_shard"]]
    assert moved and all(r["grown_shard"] == 40 for r in moved)
    assert len(moved) < 4000 / 41 * 1.5


def test_weight_changes_stay_in_their_subtree(spark):
    df = spark.range(4000).withColumn("key", F.col("id").cast("string"))
    even = S.Topology.even(16)
    heavier = S.Topology((((1.0,) * 4, (1.0,) * 4), ((1.0,) * 4, (1.0, 1.0, 1.0, 3.0))))
    both = S.place(S.place(df, even, F.col("key"), "a"), heavier, F.col("key"), "b").collect()
    for r in both:
        if r["a"] != r["b"]:
            # into the heavier region, into its heavier rack, or into the heavier shard
            assert r["b"] // 8 == 1 and (r["a"] // 8 == 0 or r["b"] // 4 == 3) and (r["a"] // 4 != 3 or r["b"] == 15)
    share = sum(r["b"] == 15 for r in both) / 4000
    assert abs(share - 3 / 18) < 0.03
    none = S.Topology((((0.0, 1.0),),))
    assert {r["a"] for r in S.place(df.limit(50), none, F.col("key"), "a").collect()} == {1}


def test_odd_rows(spark):
    df = clashing(docs_frame(spark, ODD_TEXTS)).unionByName(clashing(docs_frame(spark, ["same", "same"]).withColumn("doc_id", F.lit(None).cast("long"))))
    rows = S.assign(df).collect()
    assert len(rows) == len(ODD_TEXTS) + 2
    null = next(r for r in rows if r["doc_id"] == 0)
    assert (null["size"], null["text_crc32"]) == (16, 0)
    same = sorted((r for r in rows if r["doc_id"] is None), key=lambda r: r["slot"])
    assert same[0]["shard"] == same[1]["shard"] and same[1]["slot"] == same[0]["slot"] + 1
    assert S.assign(docs_frame(spark, [])).count() == 0


def test_plan_is_native(spark):
    assert "Python" not in S.assign(docs_frame(spark, ["a"]))._jdf.queryExecution().toString()


def test_stashes_can_be_cleared(spark):
    from cinderlog.llm import common

    kept = common.stash(spark.range(3).toDF("x"), "three")
    assert kept.count() == 3 and kept.inputFiles()[0].startswith("file:")
    common.drop_stash(kept)
    common.stash(spark.range(3).toDF("x"), "three")
    common.clear_stashes(spark)
    import os

    assert not os.path.exists(common._own_dir(spark))
