"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are lexicon densities (whole words and word beginnings, both learned from labelled texts, each weighted by its
log odds), lexicon words near second-person words, capitals, punctuation, and obfuscation (letters mixed with digits or
signs inside a word, and lexicon words found only after such signs are read as letters).

Learning takes at most SAMPLE labelled rows (those of least hash of doc_id): one part gives the lexicon, counted by
Spark, one the trees, one the calibration; the driver gets bounded tables only. Scoring covers every row and whole
texts, by slices of a few MB.

Defined cases: a null or empty text has zero features and gets their score; null labels are no labels; a null doc_id
has held_out null; an empty table gives no rows; without labels of both kinds every score is the share of label 1
(0 without labels); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import kernels as K
from cinderlog.llm.common import labelled_sample, remainder, table

SAMPLE = 16_000
THRESHOLD = 0.3
#: Lexicon: most entries, least toxic documents of an entry, least ratio of its rates in toxic and other documents.
ENTRIES, SUPPORT, LIFT = 4_000, 4, 8.0
#: Bytes of word beginnings that are entries of their own.
PREFIXES = (4, 5, 6, 7, 8, 10)
TREES, DEPTH, RATE, BINS = 80, 3, 0.15, 32
#: Words a lexicon word may be away from a second-person word.
NEAR = 4

# fixed values: second-person words of four languages
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros vuestro".split()
#: Signs read as letters where a word hides behind them.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in LEET.items():
    _LEET[ord(_a)] = ord(_b)
ALPHA = np.zeros(256, bool)
ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in "!?"]] = True
GLUE = np.zeros(256, bool)
GLUE[[ord(c) for c in "".join(LEET) + "*._-"]] = True

FEATURES = ("log_words", "lexicon_weight", "lexicon_density", "lexicon_max", "lexicon_kinds", "prefix_weight", "prefix_density", "prefix_max", "second_person", "near_second_person", "capitals", "punctuation", "obfuscation", "hidden_lexicon")


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z, and the capitals of the Latin-1 letters in UTF-8."""
    out = K.LOWER_BYTES[data]
    if len(out) > 1:
        accented = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[accented] += 32
    return out


def _entries(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, hashes) for whole words and each length of beginnings."""
    at = K.eights(low)
    out = [(np.arange(len(starts)), K.span_hash(low, starts, ends, 1, at))]
    for size in PREFIXES:
        long = np.flatnonzero(ends - starts > size)
        out.append((long, K.span_hash(low, starts[long], starts[long] + size, 1000 + size, at)))
    return out


def presence(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry of each document once: documents and hashes."""
    low = lower(data)
    starts, ends = K.runs(ALPHA[data], off)
    doc = K.owner(np.searchsorted(starts, off))
    entries = _entries(low, starts, ends)
    who = np.concatenate([doc[i] for i, _ in entries])
    key = np.concatenate([h for _, h in entries])
    order = np.lexsort((key, who))
    who, key = who[order], key[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (key[1:] != key[:-1])
    return who[new], key[new]


def _weights(lexicon: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    known, weight = lexicon
    if not len(known):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, weight[at], 0.0)


def _words(texts: list[str]) -> np.ndarray:
    blobs = [t.encode() for t in texts]
    ends = np.cumsum([len(b) for b in blobs])
    data = np.frombuffer(b"".join(blobs), np.uint8)
    return np.sort(K.span_hash(data, np.concatenate([[0], ends[:-1]]), ends, 1))


def dense(data: np.ndarray, off: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each document."""
    n = len(off) - 1
    low = lower(data)
    starts, ends = K.runs(ALPHA[data], off)
    border = np.searchsorted(starts, off)
    doc = K.owner(border)
    count = np.maximum(np.diff(border), 1).astype(float)

    def per(who: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(who, weight, n)

    out = np.zeros((n, len(FEATURES)))
    out[:, 0] = np.log1p(np.diff(border))
    (all_, whole), *begins = _entries(low, starts, ends)
    w = _weights(lexicon, whole)
    p = np.zeros(len(starts))
    for which, h in begins:
        p[which] = np.maximum(p[which], _weights(lexicon, h))
    for k, x in ((1, w), (5, p)):
        out[:, k] = per(doc, x)
        out[:, k + 1] = per(doc, (x > 0).astype(float)) / count
        np.maximum.at(out[:, k + 2], doc, x)
    hits = np.flatnonzero(w > 0)
    if len(hits):
        pairs = np.unique(np.stack([doc[hits].astype(np.uint64), whole[hits]]), axis=1)
        out[:, 4] = per(pairs[0].astype(np.int64))
    person = np.isin(whole, _words(SECOND_PERSON))
    out[:, 8] = per(doc, person.astype(float)) / count
    strong = (w > 0) | (p > 0)
    who = np.flatnonzero(strong)
    people = np.flatnonzero(person)
    if len(who) and len(people):
        left = people[np.maximum(np.searchsorted(people, who, "right") - 1, 0)]
        right = people[np.minimum(np.searchsorted(people, who), len(people) - 1)]
        close = ((np.abs(who - left) <= NEAR) & (doc[left] == doc[who])) | ((np.abs(who - right) <= NEAR) & (doc[right] == doc[who]))
        out[:, 9] = per(doc[who[close]])
    byte_doc = K.owner(off)
    letters = np.maximum(per(byte_doc, ALPHA[data].astype(float)), 1)
    out[:, 10] = per(byte_doc, UPPER[data].astype(float)) / letters
    out[:, 11] = per(byte_doc, PUNCT[data].astype(float)) / count
    # words with signs between letters
    ws, we = K.runs(ALPHA[data] | GLUE[data], off)
    alpha = np.concatenate([[0], np.cumsum(ALPHA[data])])
    mixed = np.flatnonzero(((alpha[we] - alpha[ws]) < we - ws) & (alpha[we] > alpha[ws]) & (we - ws >= 4))
    # signs at the end are punctuation: the word ends with its last letter
    last = np.zeros(len(data) + 1, np.int64)
    last[1:] = np.maximum.accumulate(np.where(ALPHA[data], np.arange(1, len(data) + 1), 0)) if len(data) else 0
    ms, me = ws[mixed], last[we[mixed]]
    inner = (alpha[me] - alpha[ms]) < me - ms
    ms, me = ms[inner], me[inner]
    mixed_doc = np.searchsorted(off, ms, "right") - 1
    out[:, 12] = per(mixed_doc) / count
    if len(ms):
        out[:, 13] = per(mixed_doc, (_weights(lexicon, K.span_hash(K.LOWER_BYTES[_LEET[low]], ms, me, 1)) > 0).astype(float))
    return out


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entries whose rate among toxic documents is LIFT times that among others, with their log odds; at most ENTRIES."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            label = np.asarray(batch.column("label"))
            for a, b in K.slices(off):
                who, key = presence(*K.cut(data, off, a, b))
                seen, at = np.unique(key, return_inverse=True)
                toxic = np.bincount(at, label[a:b][who], len(seen)).astype(np.int64)
                total = np.bincount(at, minlength=len(seen)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], names=["key", "toxic", "other"])

    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return np.zeros(0, np.uint64), np.zeros(0)
    odds = F.log(((F.col("toxic") + 0.5) / (sizes[1] + 1.0)) / ((F.col("other") + 0.5) / (sizes[0] + 1.0)))
    table_ = (
        sample.mapInArrow(K.task(counted), "key long, toxic long, other long")
        .groupBy("key")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .where(F.col("toxic") >= SUPPORT)
        .withColumn("weight", odds)
        .where(F.col("weight") >= float(np.log(LIFT)))
        .orderBy(F.desc("weight"), "key")
        .limit(ENTRIES)
        .toArrow()
    )
    key = np.asarray(table_["key"].combine_chunks()).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.asarray(table_["weight"].combine_chunks())[order]


def grow_trees(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Complete trees of DEPTH levels by logistic loss: (features, cuts) of inner nodes in heap order, values of leaves."""
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(np.concatenate([c, c[y == 1]]), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]
    total, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            place = node - first
            for f, (b, c) in enumerate(zip(binned, cuts, strict=True)):
                if not len(c):
                    continue
                m = len(c) + 1
                at = place * m + b
                gs = np.cumsum(np.bincount(at, g, width * m).reshape(width, m), 1)
                hs = np.cumsum(np.bincount(at, h, width * m).reshape(width, m), 1)
                gl, hl = gs[:, :-1], hs[:, :-1]
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                k = gain.argmax(1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                feature[first : first + width][better] = f
                cut[first : first + width][better] = c[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        total += value[leaf]
        trees.append((feature, cut, value))
    return base, trees


def margin(x: np.ndarray, base: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    out, rows = np.full(len(x), base), np.arange(len(x))
    for feature, cut, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        out += value[node - (2**DEPTH - 1)]
    return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: increasing knots (score, probability); each pool is smoothed by half a row of either label."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, lowest score, highest score
    for s, t in zip(score[order], y[order], strict=True):
        if pools and pools[-1][3] == s:
            pools[-1][0] += t
            pools[-1][1] += 1
        else:
            pools.append([t, 1, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a, b = pools[-2], pools.pop()
            pools[-1] = [a[0] + b[0], a[1] + b[1], a[2], b[3]]
    knots = [(s, (a + 0.5) / (n + 1)) for a, n, lo, hi in pools for s in ((lo, hi) if hi > lo else (lo,))]
    xs, ps = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots]) if knots else np.zeros(0)
    return xs, ps


Model = tuple[tuple[np.ndarray, np.ndarray], float, list, np.ndarray, np.ndarray]


def _features_frame(docs: DataFrame, lexicon: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off):
                x = dense(*K.cut(data, off, a, b), shared.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), *map(pa.array, x.T)], names=[*keep, *FEATURES])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"{f} double" for f in FEATURES)])
    return docs.select(*keep, "text").mapInArrow(K.task(measured), schema)


def fit(docs: DataFrame, labels: DataFrame, learn, rows: int = SAMPLE) -> Model:
    sample = labelled_sample(docs, labels, "toxic", learn, rows).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)))
    lexicon = learn_lexicon(sample.where("part < 2"))
    known = _features_frame(sample.where("part >= 2"), lexicon, ["doc_id", "label", "part"]).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    y = np.asarray(known["label"].combine_chunks(), float) if known.num_rows else np.zeros(0)
    x = np.stack([np.asarray(known[f].combine_chunks()) for f in FEATURES], 1) if known.num_rows else np.zeros((0, len(FEATURES)))
    part = np.asarray(known["part"].combine_chunks()) if known.num_rows else np.zeros(0)
    a, b = part < 4, part == 4
    if not 0 < y[a].sum() < a.sum() or not b.any():
        share = float(y.mean()) if len(y) else 0.0
        return lexicon, 0.0, [], np.zeros(1), np.array([share])
    base, trees = grow_trees(x[a], y[a])
    return lexicon, base, trees, *isotonic(margin(x[b], base, trees), y[b])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, base, trees, xs, ps = shared.value
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            out = np.zeros(len(off) - 1)
            for a, b in K.slices(off):
                out[a:b] = np.interp(margin(dense(*K.cut(data, off, a, b), lexicon), base, trees), xs, ps)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(K.task(scored), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    model = fit(docs, labels, remainder(4) != 2)
    return score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
