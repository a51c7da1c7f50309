import random

import numpy as np
import pytest
from tests.llm.helpers import ODD_TEXTS, clashing, crc, docs_frame, sentence, vocabulary

from cinderlog.llm import kernels as K
from cinderlog.llm import quality_classifier as Q
from cinderlog.llm import quality_rules as R
from cinderlog.llm import toxicity as T
from cinderlog.llm import common

BAD = ["moron", "idiot", "scum"]


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus(spark):
    r, words = random.Random(4), vocabulary(1)
    texts, labels = [], []
    for i in range(700):
        t = sentence(r, r.randint(60, 160), words) + "."
        quality, toxic = int(i % 5 != 0), int(i % 7 == 0)
        if not quality:
            t = r.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), t.replace(" ", "### "), " ".join([words[i % 50]] * 80)])
        if toxic:
            t = t[: len(t) // 2] + " you " + r.choice(BAD) + " " + t[len(t) // 2 :] + " " + r.choice(BAD)
        texts.append(t)
        labels.append((i, quality, toxic))
    return docs_frame(spark, texts).cache(), labels_frame(spark, labels).cache(), labels


def accuracy(rows, truth, key):
    held = [r for r in rows if r["held_out"]]
    assert held
    return np.mean([r[key] == truth[r["doc_id"]] for r in held])


def test_quality_classifier(corpus):
    docs, labels, truth = corpus
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == 700 and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert accuracy(rows, {i: q for i, q, _ in truth}, "predicted") > 0.95


def test_score_is_a_sparse_dot_product():
    texts = [b"the cat sat", b"", b"a a a !!", "é ü".encode()]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, f, v = Q.features(np.frombuffer(b"".join(texts), np.uint8), off, 12)
    for i in range(len(texts)):
        one = Q.features(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]), 12)
        assert np.array_equal(one[1], f[at[i] : at[i + 1]]) and np.allclose(one[2], v[at[i] : at[i + 1]])
        assert np.isclose((v[at[i] : at[i + 1]] ** 2).sum(), 1)
    # "a a a" has three tokens of one kind, one pair in the shared bucket, "!!", a pair with it, and its length
    assert at[3] - at[2] == 5


def test_held_out_labels_are_not_learned(corpus, spark):
    docs, labels, truth = corpus
    flipped = labels_frame(spark, [(i, 1 - q if crc(i) % 5 == 0 else q, 1 - t if crc(i) % 4 == 2 else t) for i, q, t in truth])
    for judge in (Q.classify, T.judge):
        assert sorted(judge(docs, labels).collect()) == sorted(judge(docs, flipped).collect())


def test_toxicity(corpus):
    docs, labels, truth = corpus
    rows = T.judge(docs, labels).collect()
    assert len(rows) == 700 and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) for r in rows)
    assert accuracy(rows, {i: t for i, _, t in truth}, "predicted") > 0.95


def test_isotonic_is_increasing():
    r = np.random.default_rng(1)
    s = r.normal(size=500)
    xs, ps = T.isotonic(s, (r.random(500) < 1 / (1 + np.exp(-3 * s))).astype(float))
    assert (np.diff(xs) >= 0).all() and (np.diff(ps) >= 0).all() and 0 < ps.min() < 0.1 and 0.9 < ps.max() < 1


def test_trees_learn_an_interaction():
    r = np.random.default_rng(2)
    x = r.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    base, trees = T.grow_trees(x, y)
    assert ((T.margin(x, base, trees) > 0) == (y > 0)).mean() > 0.99


def test_obfuscated_words_are_found():
    word = np.sort(K.span_hash(np.frombuffer(b"moron", np.uint8), np.array([0]), np.array([5]), 1))
    lexicon = (word, np.array([3.0]))
    text = "a m0r0n here. M0R-on".encode()
    row = dict(zip(T.FEATURES, T.dense(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lexicon)[0], strict=True))
    assert row["hidden_lexicon"] == 1 and row["obfuscation"] > 0


def brute_statistics(t):
    w = common.WORD and __import__("re").findall(common.WORD, t or "")
    n = len(w)
    windows = [tuple(w[i : i + 3]) for i in range(n - 2)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = [x for x in (t or "").split("\n") if __import__("re").search(common.WORD, x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_rule_statistics(spark, monkeypatch):
    r, words = random.Random(6), vocabulary(2, 12)
    texts = [*ODD_TEXTS, *("\n".join(sentence(r, r.randint(0, 30), words) for _ in range(r.randint(1, 8))) for _ in range(60)), "a b c a b c", "x x x x", "a  b\tc\x0b\x0cd\r\n", "l\nl\n \n \nl", "<#> | a&b"]
    for few in (R.FEW, 1):
        monkeypatch.setattr(R, "FEW", few)
        for row in R.judge(docs_frame(spark, texts), []).collect():
            got = tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
            assert got == brute_statistics(texts[row["doc_id"]])
            assert row["kept"] == (not row["base_failed"])


def test_rules_keep_clean_texts(corpus):
    docs, labels, truth = corpus
    rules = R.learn(docs, labels)
    assert rules and all(1 <= len(x) <= R.CONDITIONS for x in rules)
    rows = {r["doc_id"]: r for r in R.judge(docs, rules).collect()}
    assert np.mean([rows[i]["kept"] for i, q, _ in truth if q]) > 0.98
    assert np.mean([rows[i]["kept"] for i, q, _ in truth if not q]) < 0.05
    assert any("CASE WHEN" in str(x) for x in [R.rule_number(rules)._jc.toString()])
    plan = R.judge(docs, rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark, corpus):
    docs, labels, _ = corpus
    odd = clashing(docs_frame(spark, ODD_TEXTS, 5000)).unionByName(clashing(docs_frame(spark, ODD_TEXTS, 5000)))
    none, empty = labels_frame(spark, []), docs_frame(spark, [])
    nulls = labels_frame(spark, [(None, 1, 1), (1, None, None)])
    for run in (lambda d, x: Q.classify(d, x), lambda d, x: T.judge(d, x), lambda d, x: R.judge(d, R.learn(d, x))):
        assert run(odd, labels).count() == 2 * len(ODD_TEXTS)
        for few in (none, nulls):
            rows = run(odd, few).collect()
            assert len(rows) == 2 * len(ODD_TEXTS)
        assert run(empty, labels).count() == 0
    assert {r["score"] for r in Q.classify(odd, none).collect()} == {0.5}
    null_id = odd.withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("long"))
    assert all(r["held_out"] is None for r in Q.classify(null_id, labels).collect())


def plain_features(text, bits):
    """Hashed tokens and pairs by a dictionary; the hashes themselves are the operator's."""
    import re

    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", text)
    hashed = [int(K.span_hash(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
    mix = lambda x: int(K.mix(np.array([x % 2**64], np.uint64))[0])
    keys = [*hashed, mix(int(np.floor(np.log2(len(tokens) + 1))) + Q.LENGTH)]
    for a, b in zip(hashed, hashed[1:], strict=False):
        keys.append(Q.TWICE if a == b else mix(a * 3 + mix(b)))
    out = {}
    for k in keys:
        out[k % 2**bits] = out.get(k % 2**bits, 0) + 1
    out = {k: 1 + np.log(c) for k, c in out.items()}
    norm = np.sqrt(sum(v * v for v in out.values()))
    return {k: v / norm for k, v in out.items()}


def test_training_and_scores_are_those_of_a_plain_version():
    r = random.Random(3)
    words = vocabulary(4, 60)
    texts = [(sentence(r, r.randint(0, 25), words) + (" !!" if i % 3 else "")).encode() for i in range(80)]
    label = [float(i % 3 != 0 or i % 7 == 0) for i in range(80)]
    bits, epochs = 10, 3
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    at, f, v = Q.features(np.frombuffer(b"".join(texts), np.uint8), off, bits)
    rows = [plain_features(t, bits) for t in texts]
    for i, row in enumerate(rows):
        assert dict(zip(f[at[i] : at[i + 1]].tolist(), v[at[i] : at[i + 1]].tolist(), strict=True)) == pytest.approx(row)
    w, bias = Q.train(at, f, v, np.array(label), bits, epochs)
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= Q.L1 else (np.sign(z[k]) * Q.L1 - z[k]) / ((Q.BETA + np.sqrt(n[k])) / Q.ALPHA + Q.L2)
    share = sum(label) / len(label)
    b, b_n, order = np.log(share / (1 - share)), 1.0, np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(label)).tolist():
            p = 1 / (1 + np.exp(-(b + sum(weight(k) * x for k, x in rows[i].items()))))
            for k, x in rows[i].items():
                g, before, old = (p - label[i]) * x, weight(k), n.get(k, 0.0)
                n[k] = old + g * g
                z[k] = z.get(k, 0.0) + g - (np.sqrt(n[k]) - np.sqrt(old)) / Q.ALPHA * before
            b_n += (p - label[i]) ** 2
            b -= 0.1 * (p - label[i]) / np.sqrt(b_n)
    assert bias == pytest.approx(b) and np.allclose(w, [weight(k) for k in range(1 << bits)], atol=1e-5)


def test_text_ids_and_repeated_rows(spark, corpus):
    docs, labels, _ = corpus
    F = __import__("pyspark.sql.functions", fromlist=["lit"])
    named = lambda df: df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    twice = named(docs).unionByName(named(docs))
    for run in (Q.classify, T.judge, lambda d, x: R.judge(d, R.learn(d, x))):
        rows = run(twice, named(labels)).collect()
        assert len(rows) == 1400 and len(set(rows)) == 700
