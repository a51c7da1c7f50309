import os
import random

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as CP
from cinderlog.llm import bpe, queries, secrets
from cinderlog.llm import decontamination as D
from cinderlog.llm import quality_classifier as Q
from tests.llm.helpers import ODD_TEXTS, clashing, crc, docs_frame, sentence, vocabulary
from tests.llm.test_corpus_operators import brute_contamination, near_copies, shingle_set

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r, words = random.Random(11), vocabulary(9, 300)
    items = [(i, sentence(r, 30, words)) for i in range(4)]
    texts, labels = [], []
    for i in range(400):
        t = sentence(r, r.randint(60, 140), words) + "."
        quality = int(i % 6 != 0)
        if not quality:
            t = t.replace(" ", "### ")
        elif i % 10 == 1:
            t += " " + items[i % 4][1]
        elif i % 10 == 3:
            t += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
        texts.append(t)
        labels.append((i, quality, 0))
    for k in (1, 5, 7, 13, 25):
        texts += near_copies(r, texts[k], 5, 1)
    folder = str(tmp_path_factory.mktemp("sf"))
    clashing(docs_frame(spark, texts)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, texts, items, labels


def brute_near(texts):
    sets = [shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


def test_stages(spark, corpus):
    folder, texts, items, labels = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = list(CP.COLUMNS)
    kept = CP.STAGES[0][1](spark, docs, folder)
    assert kept.columns == columns
    scores = {r["doc_id"]: r["predicted"] for r in Q.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    left = sorted(r["doc_id"] for r in kept.collect())
    assert left == sorted(i for i, p in scores.items() if p)
    assert all((i in left) == bool(q) for i, q, _ in labels)

    one = CP.STAGES[1][1](spark, kept, folder)
    assert one.columns == columns
    roots = brute_near([texts[i] for i in left])
    left = sorted({left[k] for k in roots})
    assert sorted(r["doc_id"] for r in one.collect()) == left

    clean = CP.STAGES[2][1](spark, one, folder)
    bad = brute_contamination([texts[i] for i in left], items)
    left = [i for i, b in zip(left, bad, strict=True) if not b[4]]
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == left

    masked = CP.STAGES[3][1](spark, clean, folder)
    rows = {r["doc_id"]: r for r in masked.collect()}
    assert masked.columns == columns and sorted(rows) == left
    for i in left:
        want = texts[i].replace("04dbebab91ab85687d33eeaaf9ac699e1188f962", secrets.MASK)
        assert (rows[i]["text"], rows[i]["n_chars"]) == (want, len(want))

    ids = CP.STAGES[4][1](spark, masked, folder)
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode_ids(ids, public_tokenizers.path(bpe.VOCABULARY)).collect()}
    assert back == {i: rows[i]["text"] for i in left}

    whole = CP.run(spark, folder)
    assert {r["doc_id"]: r["ids"] for r in whole.collect()} == {r["doc_id"]: r["ids"] for r in ids.collect()}


def test_odd_rows(spark, corpus):
    folder = corpus[0]
    odd = clashing(docs_frame(spark, ODD_TEXTS)).unionByName(clashing(docs_frame(spark, ODD_TEXTS)))
    odd = odd.unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    empty = odd.limit(0)
    for _, stage in CP.STAGES:
        assert stage(spark, empty.select(*CP.COLUMNS), folder).count() == 0
        stage(spark, odd.select(*CP.COLUMNS), folder).collect()
    one = CP.near_duplicates(spark, odd.select(*CP.COLUMNS), folder).collect()
    # texts without words are linked with nothing, but a row that repeats stays once
    assert sorted(r["doc_id"] for r in one if r["doc_id"] is not None) == list(range(len(ODD_TEXTS)))


def test_one_of_each_group_stays_without_ids_too(spark, corpus):
    r = random.Random(2)
    base = sentence(r, 300)
    docs = docs_frame(spark, near_copies(r, base, 9, 2) + [base] * 3 + [sentence(r, 50)])
    for ids in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.when(F.col("doc_id") > 4, F.col("doc_id"))):
        assert CP.near_duplicates(spark, docs.withColumn("doc_id", ids), corpus[0]).count() == 2
    left = CP.near_duplicates(spark, docs.withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id"))), corpus[0])
    assert sorted(x["doc_id"] for x in left.collect()) == [5, 12]


def test_names_and_tables(spark):
    assert [n for n, _ in CP.STAGES] == ["quality", "near_duplicates", "decontaminate", "mask_secrets", "tokens"]
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*columns).collect())
    want = con.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(want.select(", ".join(columns)).fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_contract_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = {2: 5, 6: 10}
    first = {int(k[2:].split("_")[0]): q for k, q in queries.QUERIES.items()}
    for n, modulus in held.items():
        rows = first[n](spark, SF).collect()
        assert len(rows) == docs.count() and all(r["held_out"] == (crc(r["doc_id"]) % modulus == 0) for r in rows)
    assert D.WINDOW == 13
