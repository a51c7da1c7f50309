import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import components as C
from cinderlog.llm import decontamination as D
from cinderlog.llm import jaccard as J
from cinderlog.llm import kernels as K
from cinderlog.llm import pitman_yor as P
from cinderlog.llm import suffix_dedup as S
from cinderlog.llm.common import drop_stash, remainder, stash
from tests.llm.helpers import ODD_TEXTS, SPACE_WORD, clashing, crc, docs_frame, lower_ascii, sentence, sha, vocabulary

# n-gram Jaccard join


def shingle_set(t, size=4):
    w = SPACE_WORD.findall(lower_ascii(t or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_components(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(r, text, n, edits):
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def corpus(seed):
    r, words = random.Random(seed), vocabulary(seed, 300)
    common = sentence(r, 9, words)
    texts = list(ODD_TEXTS)
    for n in (1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 33, 60, 120, 260, 600):
        base = sentence(r, n, words)
        texts += near_copies(r, base, 6, max(1, n // 45))
        texts += [common + "\n" + base, base.upper(), base + " " + sentence(r, max(1, n // 9), words)]
    # a chain: each is near the next only
    w = sentence(r, 150, words).split()
    for k in range(12):
        w[12 * k] = f"link{k}"
        texts.append(" ".join(w))
    # an original with copies that are further from each other than from it
    base = sentence(r, 200, words)
    for k in range(30):
        w = base.split()
        for x in range(3):
            w[(k * 6 + x * 61) % 200] = f"own{k}x{x}"
        texts.append(" ".join(w))
    return texts + [base] * 25 + [common] * 3


@pytest.mark.parametrize(("seed", "chunk"), [(1, J.CHUNK), (2, 4)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(J, "CHUNK", chunk)  # small chunks: large cells go by pairs of chunks
    texts = corpus(seed)
    sizes, roots = brute_components(texts)
    got = {r["doc_id"]: r for r in J.join(clashing(docs_frame(spark, texts)).repartition(3)).collect()}
    assert len(got) == len(texts)
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == roots
    assert len(set(roots)) < len(texts) - 80


def test_linked_sets_share_a_cell():
    r = np.random.default_rng(3)
    for n in [*range(1, 60), 127, 128, 150, 255, 256, 300, 511, 1000, 2047, 2049]:
        u = np.unique(r.integers(0, 2**64 - 1, n, np.uint64))
        for _ in range(6):
            # the worst case: as many different shingles as a link allows
            drop = int(r.integers(0, n + 1))
            keep = u[drop:]
            add = np.unique(r.integers(0, 2**64 - 1, int(r.integers(0, max(2, n // 5))), np.uint64))
            v = np.unique(np.concatenate([keep, add]))
            common = len(np.intersect1d(u, v))
            # equal sets are one class and need no cell
            if common < max(len(u), len(v)) and common and 100 * common >= 85 * (len(u) + len(v) - common):
                assert len(np.intersect1d(J.cells(u), J.cells(v)))
        least = -(-85 * n // 100)
        v = u[n - least :]
        assert least == n or len(np.intersect1d(J.cells(u), J.cells(v)))
        # the other threshold in use
        least = -(-80 * n // 100)
        v = u[n - least :]
        assert least == n or len(np.intersect1d(J.cells(u, 80, 100), J.cells(v, 80, 100)))


@pytest.mark.parametrize(("num", "den"), [(85, 100), (80, 100), (9, 10)])
def test_sizes_that_can_link_share_a_window(num, den):
    for n in [*range(1, 300), 1000, 4097, 50_000]:
        for m in {n, n + 1, (n + n * den // num) // 2, n * den // num}:
            if n < m <= n * den // num:
                assert set(J.windows(n, num, den)) & set(J.windows(m, num, den)), (n, m)


def test_unrelated_sets_share_few_cells():
    r = np.random.default_rng(8)
    for n in (16, 40, 64, 128, 200, 256, 512, 1024, 4096):
        for many in (100, 400):
            keys = np.concatenate([J.cells(np.unique(r.integers(0, 2**64 - 1, int(n * r.uniform(0.9, 1.1)), np.uint64))) for _ in range(many if n < 2000 else many // 4)])
            assert np.unique(keys, return_counts=True)[1].max() == 1


def test_a_set_of_too_many_sparse_blocks_meets_its_likes_by_a_prefix(monkeypatch):
    monkeypatch.setattr(J, "scheme", lambda number, num, den: (40, 0, 3))  # every set has a sparse block
    r = np.random.default_rng(9)
    u = np.unique(r.integers(0, 2**64 - 1, 100, np.uint64))
    v = np.union1d(u[:93], r.integers(0, 2**64 - 1, 7, np.uint64))
    assert len(np.intersect1d(J.cells(u), J.cells(v)))


def test_shared_keys_come_out_whatever_the_order():
    r = np.random.default_rng(10)
    key, sig = r.integers(0, 300, 1000).astype(np.uint64), r.integers(0, 40, 1000)
    want = {(k, s) for k, s in zip(key.tolist(), sig.tolist(), strict=True) if len(set(sig[key == k].tolist())) > 1}
    for step in (1, 7, 1000):
        bucket, got = J.Shared(), set()
        for k in range(0, 1000, step):
            a, b = bucket.add(key[k : k + step], sig[k : k + step])
            got |= set(zip(a.tolist(), b.tolist(), strict=True))
        assert got == want


def test_a_forest_joins_all_links_with_few_rows():
    r = np.random.default_rng(11)
    base = r.integers(0, 2**64 - 1, 200, np.uint64)
    sets = [np.union1d(np.delete(base, r.integers(0, 200, 8)), r.integers(0, 2**64 - 1, 8, np.uint64)) for _ in range(120)]
    u, border = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    found = J.forest(u, border, np.arange(120), np.full(120, -1), 85, 100)
    links = [(i, j) for i in range(120) for j in range(i) if J._link(sets[i], sets[j], 85, 100)]

    def parts(pairs):
        root = list(range(120))
        for a, b in pairs:
            a, b = root[a], root[b]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    assert parts(found) == parts(links) and len(found) == 120 - len(set(parts(links))) < len(links)


def test_counts_of_any_size_stay_whole():
    big = np.zeros(J.GROUPS, np.int64)
    big[:3] = (70_000, 255, 3)
    assert J.unpacked([J.packed(big), J.packed(big % 200)]).tolist() == [big.tolist(), (big % 200).tolist()]
    # over 65,536 shingles in one group
    u = np.arange(70_000, dtype=np.uint64) << np.uint64(15)
    assert J.points(u, np.array([0, len(u)]))[0, 0] == 70_000


def test_join_without_broadcasts_by_text_ids_and_other_thresholds(spark, monkeypatch):
    texts = corpus(5)
    plain = {r["doc_id"]: r["component_id"] for r in J.join(docs_frame(spark, texts)).collect()}
    from cinderlog.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    named = docs_frame(spark, texts).withColumn("doc_id", F.format_string("%05d", "doc_id"))
    assert {int(r["doc_id"]): int(r["component_id"]) for r in J.join(named).collect()} == plain
    sets = [shingle_set(t, 5) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    assert [r["component_id"] for r in J.join(docs_frame(spark, texts), 80, 100, 5).orderBy("doc_id").collect()] == root


def test_sets_are_stored_only_for_classes_within_the_bound(spark, monkeypatch):
    words = [f"w{i}" for i in range(100)]
    # half alike, so they share cells but can't link; the last two link
    texts = [" ".join(words[:70] + [f"x{k}_{i}" for i in range(30)]) for k in range(8)] + [" ".join([f"y{i}" for i in range(120)] + [e]) for e in "ab"]
    stored, stash = {"set": 0, "point": 0}, J.stash

    def counted(df, name, *rest):
        out = stash(df, name, *rest)
        for c in stored:
            stored[c] += out.count() if c in out.columns else 0
        return out

    monkeypatch.setattr(J, "stash", counted)
    rows = J.join(docs_frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in rows] == [*range(8), 8, 8]
    assert stored["point"] > 2 and stored["set"] == 2


def test_exact_sets_are_compared_in_rounds(spark, monkeypatch):
    texts = corpus(6)
    plain = {r["doc_id"]: r["component_id"] for r in J.join(docs_frame(spark, texts)).collect()}
    monkeypatch.setattr(J, "ROUND_BYTES", 200)
    assert {r["doc_id"]: r["component_id"] for r in J.join(docs_frame(spark, texts)).collect()} == plain
    assert len(set(plain.values())) < len(plain)


def test_released_references_have_reached_the_jvm(spark):
    from cinderlog.llm.common import release_shuffles

    waiting = spark.sparkContext._gateway._gateway_client.finalizer_deque
    frames = [spark.range(3) for _ in range(200)]
    del frames
    release_shuffles(spark)
    assert len(waiting) < 100


def test_rtree_finds_all_pairs_of_the_bound():
    r = np.random.default_rng(4)
    base = r.integers(0, 4, (30, J.GROUPS))
    points = np.concatenate([base, np.maximum(base + r.integers(-1, 2, base.shape) * (r.random(base.shape) < 0.1), 0), base]).astype(np.uint16)
    sizes = points.sum(1).astype(np.int64)
    got = sorted((int(min(a, b)), int(max(a, b))) for i, j in J.RTree(points, sizes).pairs() for a, b in zip(i, j, strict=True))
    want = [(i, j) for i in range(90) for j in range(i + 1, 90) if np.minimum(points[i], points[j]).sum() >= J.needed(sizes[i], sizes[j])]
    assert got == sorted(want) and len(want) >= 30


def test_join_of_odd_tables(spark):
    assert J.join(docs_frame(spark, [])).count() == 0
    none = docs_frame(spark, ["a b c d e f"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    rows = J.join(none.unionByName(docs_frame(spark, ["a b c d e f", "", None]))).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in rows if r["n_shingles"]) == [(False, 0), (True, 0), (True, 0)]
    assert sorted(r["component_id"] for r in rows if not r["n_shingles"]) == [1, 2]


def test_components_of_links(spark):
    r = random.Random(5)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(100)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x["node"]: x["label"] for x in C.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for e in links if e[0] != e[1] for x in e}
    assert C.components(spark.createDataFrame([], "u long, v long")).count() == 0


# repeated byte strings


def brute_repeats(texts, length=S.LENGTH):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        n_spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), n_spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def repeating(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(200)]
    passages = [sentence(r, r.randint(20, 80), words) for _ in range(6)]
    texts = []
    for _ in range(150):
        parts = [r.choice(passages)[r.randint(0, 30) :] if r.random() < 0.5 else sentence(r, r.randint(1, 40)) for _ in range(r.randint(0, 5))]
        texts.append(" ".join(parts))
    return [*texts, *ODD_TEXTS, "a" * 3000, "ab" * 900, "a" * 150 + "\0" * 300, "\0" * 400, texts[5], texts[5], "x" * 99, "x" * 100, "x" * 101, "a" * 120]


@pytest.mark.parametrize("cap", [S.CAP, 6])
def test_removed_bytes(spark, monkeypatch, cap):
    monkeypatch.setattr(S, "CAP", cap)  # small: common lead grams are split and merged
    texts = repeating(cap)
    rows = S.dedup(clashing(docs_frame(spark, texts)).repartition(4)).collect()
    want = brute_repeats(texts)
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) == want[r["doc_id"]]
    assert sum(w[1] for w in want) > 0.3 * sum(w[0] for w in want)


def test_snippets_of_pieces_are_those_of_the_whole(monkeypatch):
    r = random.Random(12)
    text = (sentence(r, 3000) + " ") * 2 + sentence(r, 500)
    data, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    monkeypatch.setattr(S, "PLACE", 14)
    first, last, gram, border = S.snippets(data, off)
    # windows are whole, in order, and equal ones have equal lead grams although pieces cut the text
    assert first[0] == 0 and last[-1] == len(text) - S.LENGTH and (first[1:] == last[:-1] + 1).all() and border.tolist() == [0, len(first)]
    lead = np.repeat(gram, last - first + 1)
    seen = {}
    for i in range(len(text) - S.LENGTH + 1):
        assert seen.setdefault(text[i : i + S.LENGTH], lead[i]) == lead[i]


def test_long_texts_and_text_ids(spark):
    r = random.Random(13)
    passage = sentence(r, 200)
    texts = [sentence(r, 30_000) + passage + sentence(r, 4000), "short " + passage, passage, sentence(r, 7000), passage]
    want = [w[1:] for w in brute_repeats(texts)]
    named = docs_frame(spark, texts).withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    for docs in (docs_frame(spark, texts), named):
        got = {int(str(x["doc_id"]).lstrip("d")): (x["n_removed"], x["n_spans"], sha(bytes(x["kept"]))) for x in S.dedup(docs).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_suffix_array_and_common_prefixes():
    r = random.Random(6)
    for _ in range(30):
        parts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        text = np.frombuffer(b"".join(parts), np.uint8)
        end = np.cumsum([len(p) for p in parts])
        start = end - [len(p) for p in parts]
        limit = np.repeat(end, end - start)
        order = S.suffix_array(text, limit, 40)
        suffix = [text[i : limit[i]].tobytes() for i in range(len(text))]
        assert order.tolist() == sorted(range(len(text)), key=lambda i: (suffix[i], i))
        shared = S.common_prefixes(text, start, end, order, 15)
        for k in range(1, len(order)):
            a, b = suffix[order[k - 1]], suffix[order[k]]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 15)


def test_merge_by_binary_search():
    shards = [(np.array([b"b", b"d"], "S1"), np.array([5, 2])), (np.array([b"a", b"b", b"e"], "S1"), np.array([1, 3, 9])), (np.array([b"d"], "S1"), np.array([7]))]
    windows, least = S.merge_shards(shards)
    assert (windows.tolist(), least.tolist()) == ([b"a", b"b", b"d", b"e"], [1, 3, 2, 9])


def test_repeats_of_odd_tables(spark):
    assert S.dedup(docs_frame(spark, [])).count() == 0
    assert S.dedup(docs_frame(spark, ["short", None])).agg(F.sum("n_removed")).first()[0] == 0
    t = "abc " * 60
    same = docs_frame(spark, [t]).unionByName(docs_frame(spark, [t]))
    a, b = S.dedup(same).collect()
    assert a == b and a["n_removed"] == len(t) - 4 and bytes(a["kept"]) == b"abc "
    late = docs_frame(spark, ["y" + "".join(map(chr, range(40, 126))) * 2]).withColumn("doc_id", F.lit(None).cast("long"))
    whole = "".join(map(chr, range(40, 126))) * 2
    rows = S.dedup(late.unionByName(docs_frame(spark, [whole]))).collect()
    assert {r["doc_id"]: (r["n_removed"] > 100) for r in rows}[None]


# decontamination


def brute_contamination(texts, items, size=13):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t or "")) if w]
    out = []
    for t in texts:
        w = cut(t)
        hit, names = set(), set()
        for name, item in items:
            v = cut(item)
            for i in range(max(1, len(v) - size + 1) if v else 0):
                x = v[i : i + size]
                for at in range(len(w) - len(x) + 1):
                    if w[at : at + len(x)] == x:
                        hit |= set(range(at, at + len(x)))
                        names.add(str(name))
        out.append((len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_contamination(spark):
    r, words = random.Random(7), vocabulary(3, 60)
    items = [(i, sentence(r, n, words)) for i, n in enumerate([40, 30, 13, 14, 5, 1, 25, 0])] + [(10, "The-Same item, twice"), (11, "the same ITEM twice"), (12, None), (13, "rare " + " ".join(["the"] * 20))]
    texts = list(ODD_TEXTS)
    for _ in range(80):
        parts = []
        for _ in range(r.randint(0, 4)):
            item = (r.choice(items)[1] or "").split()
            a = r.randrange(len(item) + 1)
            parts += item[a : a + r.randint(5, 20)] if r.random() < 0.6 else sentence(r, r.randint(1, 90), words).split()
        texts.append(r.choice([" ", ", "]).join(parts))
    texts += ["the same item twice " * 4, "the " * 60, items[0][1].upper() + " " + items[0][1], texts[20], items[5][1]]
    benchmark = clashing(spark.createDataFrame(items, "item_id long, text string"))
    rows = D.contamination(clashing(docs_frame(spark, texts)).repartition(3), benchmark).collect()
    want = brute_contamination(texts, items)
    assert len(rows) == len(texts)
    for x in rows:
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == want[x["doc_id"]]
    assert sum(w[4] for w in want) > 10


def test_contamination_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert D.contamination(docs_frame(spark, []), items).count() == 0
    assert {r["n_hit"] for r in D.contamination(docs_frame(spark, ["one two three", None]), items.limit(0)).collect()} == {0}
    none = docs_frame(spark, ["One two, three!", "four"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows = D.contamination(none.unionByName(none), items).collect()
    assert sorted(r["n_hit"] for r in rows) == [0, 0, 3, 3]
    plan = D.contamination(none, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two")], "item_id long, text string")
    texts = ["alpha x beta gamma y delta", "delta gamma beta alpha", "alpha x x x x beta gamma delta", "alpha beta gamma", "one " + "x " * 30 + "two", "two one"]
    got = sorted((r["doc_id"], r["item"]) for r in D.proximity_matches(docs_frame(spark, texts), items, 2).collect())
    assert got == [(0, "1"), (1, "1"), (5, "2")]


# language model


def learning(docs):
    return docs.withColumn("learn", remainder(10) != 0)


def brute_base(texts, learned):
    words = [[*SPACE_WORD.findall(lower_ascii(t or "")), None] for t in texts]
    count = Counter(w for i in learned for w in words[i])
    n, v = sum(count.values()), len(count)
    return n, [(len(w), sum(x in count for x in w), sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for w in words]


@pytest.mark.parametrize(("head", "bucket", "gather"), [(P.HEAD, P.BUCKET, P.GATHER), (7, 2000, 500)])
def test_base_score_and_counts(spark, monkeypatch, head, bucket, gather):
    monkeypatch.setattr(P, "HEAD", head)
    monkeypatch.setattr(P, "BUCKET", bucket)
    r, words = random.Random(7), vocabulary(5, 200)
    texts = [sentence(r, r.randint(0, 60), words).title() for _ in range(120)] + ODD_TEXTS + ["a b c", "a b c"]
    docs = clashing(docs_frame(spark, texts).unionByName(docs_frame(spark, texts[:20], 5000)))
    every = texts + texts[:20]
    ids = [*range(len(texts)), *range(5000, 5020)]
    train_tokens, want = brute_base(every, [k for k, i in enumerate(ids) if crc(i) % 10 != 0])
    rows = {x["doc_id"]: x for x in P.score(learning(docs)).collect()}
    assert sorted(rows) == sorted(ids)
    for i, (n, known, base) in zip(ids, want, strict=True):
        x = rows[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"]) == (n, known, train_tokens)
        assert math.isclose(x["base_score"], base, rel_tol=1e-9) and x["score"] < 0
    for i in range(20):
        assert math.isclose(rows[i]["score"], rows[5000 + i]["score"], rel_tol=1e-12)


def plain_model(model, tables):
    """The model's stored blocks as dictionaries: customers and tables by pair, and the parent's probabilities by word."""
    n, t, p0 = {}, {}, {}
    for number, rows in P._groups(iter(sum((df.toArrow().select(P._NAMES).sort_by([("bucket", "ascending"), ("kind", "ascending"), ("part", "ascending")]).to_batches() for df in [P._of_buckets(tables)]), [])), 0):
        b = P.Bucket(P._kinds(rows)[0], model)
        for k in range(len(b.a)):
            pair = (int(b.context[b.of[k]]), int(b.asked[b.a[k]].view(np.int64)))
            n[pair], t[pair] = int(b.n[k]), float(b.t[k])
        p0 |= {int(w.view(np.int64)): float(p) for w, p in zip(b.asked, b.p0, strict=True)}
    return n, t, p0


@pytest.mark.parametrize("split", [0, P.SPLIT])
def test_scores_are_those_of_a_plain_version_and_sum_to_one(spark, monkeypatch, split):
    monkeypatch.setattr(P, "BUCKET", 3000)
    monkeypatch.setattr(P, "SPLIT", split)  # frequent contexts are split over buckets
    monkeypatch.setattr(P, "SAMPLE", 2)
    r, words = random.Random(8), vocabulary(6, 90)
    texts = [sentence(r, r.randint(0, 60), words[: r.choice([8, 90])]) for _ in range(150)] + ["never seen words here", None]
    docs = learning(docs_frame(spark, texts).select("doc_id", "text"))
    model, tables = P.train(docs)
    n, t, p0 = plain_model(model, tables)
    assert (len(model.layout.split) > 0) == (split > 0)
    customers, seated, theta = Counter(), Counter(), P.CONCENTRATION
    for (u, w), c in n.items():
        customers[u] += c
        seated[u] += t[u, w]
        assert (t[u, w] == c) if c < 2 else (1 <= t[u, w] <= c)
    known = {w for (u, w), c in n.items() if c}
    assert model.words == len(known) and model.tokens == sum(n.values()) and math.isclose(model.t_0, sum(t.values()), rel_tol=1e-9)
    unknown = float(model.parent(np.zeros(1), np.zeros(1))[0])
    assert math.isclose(sum(p0[w] for w in known) + unknown, 1, rel_tol=1e-9)

    def p(u, w):
        share = (theta + model.d1 * seated[u]) / (theta + customers[u])
        return (n.get((u, w), 0) - model.d1 * t.get((u, w), 0)) / (theta + customers[u]) + share * p0.get(w, unknown)

    for u in list(customers)[:10]:
        rest = (theta + model.d1 * seated[u]) / (theta + customers[u]) * unknown
        assert math.isclose(sum(p(u, w) for w in known) + rest, 1, rel_tol=1e-9)
    rows = {x["doc_id"]: x["score"] for x in P.score(docs).collect()}
    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), np.uint8)
        word, context, _ = P.tokens(data, np.array([0, len(data)]))
        want = sum(math.log10(p(int(u), int(w))) for u, w in zip(context, word, strict=True))
        assert math.isclose(rows[i], want, rel_tol=1e-9)


def test_index_finds_what_is_known():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 4000):
        known = np.unique(np.concatenate([r.integers(0, 2**64 - 1, n, np.uint64), np.arange(min(n, 40), dtype=np.uint64)]))
        asked = np.concatenate([known, r.integers(0, 2**64 - 1, 500, np.uint64), np.arange(90, dtype=np.uint64)])
        at, met = P.Index(known).find(asked)
        assert met.tolist() == np.isin(asked, known).tolist() and (known[at[met]] == asked[met]).all()


def test_hashes_are_ordered_by_a_sort_of_values():
    r = np.random.default_rng(3)
    close = np.uint64(5 << 60) + r.integers(0, 40, 300).astype(np.uint64)  # equal first bits
    for keys in (np.zeros(0, np.uint64), close[:1], close, np.concatenate([r.integers(0, 2**64 - 1, 5000, np.uint64)] * 2 + [close[:60]]), r.integers(-50, 50, 4000)):
        want = np.argsort(keys.view(np.uint64), kind="stable")
        places, out = K.order(keys)
        assert places.tolist() == want.tolist() and (out == keys.view(np.uint64)[want]).all()
        known, which = K.distinct(keys)
        assert known.tolist() == sorted(set(keys.view(np.uint64).tolist())) and (known[which] == keys.view(np.uint64)).all()


def test_figures_that_travel_are_narrow():
    means = np.array([0.0, 1.25, 7.5, 2.0**29 - 0.25])
    assert P._narrow(means).nbytes == 16 and (P._widened(P._narrow(means).tobytes(), 4) == means).all()
    for other in (means / 3, means + 2.0**31):
        assert P._narrow(other).nbytes == 32 and (P._widened(P._narrow(other).tobytes(), 4) == other).all()


def test_stored_kinds_are_read_apart(spark):
    kept = stash(spark.range(40, numPartitions=2).select((F.col("id") % 4).cast("int").alias("kind"), "id"), "apart", by="kind")
    one = kept.where(F.col("kind") == 3)
    assert one.columns == ["kind", "id"] and sorted(r["id"] for r in one.collect()) == list(range(3, 40, 4))
    assert "PartitionFilters: [isnotnull(kind" in one._jdf.queryExecution().toString()
    files = kept.inputFiles()
    drop_stash(kept)
    assert len(files) == 8 and not any(os.path.exists(f.removeprefix("file:").rpartition("/kind=")[0]) for f in files)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 3000)
    r, words = random.Random(9), vocabulary(7, 90)
    docs = learning(docs_frame(spark, [sentence(r, r.randint(0, 80), words) for _ in range(200)]).select("doc_id", "text"))
    one, other = ({x["doc_id"]: x["score"] for x in P.score(docs.repartition(k, "text").sortWithinPartitions(order)).collect()} for k, order in ((1, "doc_id"), (7, "text")))
    assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], rel_tol=1e-9) for i in one)


def test_context_helps(spark):
    r = random.Random(10)
    a, b = ["qa", "wa", "ea", "ra"] * 3, ["to", "yo", "uo", "po"] * 3
    texts = [" ".join(r.choice(s) for _ in range(40)) for s in [a, b] * 150]
    scored = P.score(learning(docs_frame(spark, texts).select("doc_id", "text")))
    p = P.perplexity(scored.where(remainder(10) == 0)).first()
    assert p["perplexity"] < 0.7 * p["base_perplexity"]


def test_contexts_are_whole_words(spark):
    # the words before share their ending; what follows depends on the whole word
    r = random.Random(11)
    two = lambda k: f"w{k}xyz afterw{k}xyz"
    texts = [" ".join(two(r.randint(0, 299)) for _ in range(30)) for _ in range(200)]
    scored = P.score(learning(docs_frame(spark, texts).select("doc_id", "text")))
    p = P.perplexity(scored.where(remainder(10) == 0)).first()
    # half of the tokens are certain, the others one of 300: about 17
    assert p["perplexity"] < 30 < p["base_perplexity"] / 10


def test_tables_are_drawn_from_their_conditional():
    rng, d, w, n = np.random.default_rng(1), 0.4, 0.7, 6
    s = P._log_stirling(d)
    # S(n, t) by its definition: seatings of n customers at t tables
    weight = {(1,): 1.0}
    for _ in range(n - 1):
        grown = Counter()
        for tables, p in weight.items():
            grown[(*tables, 1)] += p
            for k in range(len(tables)):
                grown[(*tables[:k], tables[k] + 1, *tables[k + 1 :])] += p * (tables[k] - d)
        weight = grown
    by_t = Counter()
    for tables, p in weight.items():
        by_t[len(tables)] += p
    for t in range(1, n + 1):
        assert math.isclose(math.exp(s[n, t]), by_t[t], rel_tol=1e-9)
    got = np.bincount(P.draw_tables(np.full(40000, n), np.full(40000, w), d, s, rng), minlength=n + 1)[1:] / 40000
    want = np.array([by_t[t] * w**t for t in range(1, n + 1)])
    assert np.abs(got - want / want.sum()).max() < 0.01
    many = P.draw_tables(np.array([0, 1, 500]), np.array([1.0, 1.0, 1.0]), d, s, rng)
    assert many[0] == 0 and many[1] == 1 and 1 <= many[2] <= 500


@pytest.mark.parametrize(("d", "n", "w"), [(0.5, 500, 5.0), (0.8, 500, 5.0), (0.5, 3000, 5.0), (0.8, 3000, 50.0), (0.5, 2000, 1500.0)])
def test_many_customers_are_seated_by_the_same_conditional(d, n, w):
    s = P._log_stirling(d, n)
    logits = s[n, 1 : n + 1] + np.arange(1, n + 1) * math.log(w)
    want = np.exp(logits - logits.max())
    want = np.cumsum(want / want.sum())
    t = P.draw_tables(np.full(20000, n), np.full(20000, w), d, P._log_stirling(d), np.random.default_rng(2))
    got = np.cumsum(np.bincount(t, minlength=n + 1)[1:]) / 20000
    assert np.abs(got - want).max() < 0.03


def test_model_of_odd_tables(spark):
    empty = docs_frame(spark, []).select("doc_id", "text")
    assert P.score(learning(empty)).count() == 0
    none = docs_frame(spark, ["a b", None, "a b"]).select("doc_id", "text")
    for learn in (F.lit(False), F.lit(None).cast("boolean")):
        rows = P.score(none.withColumn("learn", learn)).collect()
        assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 3
    named = none.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.concat(F.lit("d"), "doc_id"))).withColumn("learn", F.lit(True))
    rows = {r["doc_id"]: r for r in P.score(named).collect()}
    assert set(rows) == {None, "d1", "d2"} and rows[None]["score"] == rows["d2"]["score"]
    long = docs_frame(spark, ["x y " * 300_000, "x y"]).select("doc_id", "text").withColumn("learn", F.lit(True))
    assert sorted(r["n_tokens"] for r in P.score(long).collect()) == [3, 600_001]
