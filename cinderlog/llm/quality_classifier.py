"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Tokens are runs of letters and digits or runs of symbols, so that junk glued to a word is a token of its own. Features
are hashed tokens and pairs of neighbours; a pair of one token twice falls in one shared bucket, whatever the token,
and the log2 of the word count is a token too. A document's vector holds 1 + ln(count) for each feature, scaled to unit
length, so that a score is a sparse dot product.

Training takes at most SAMPLE labelled rows, those of least hash of doc_id: a fixed bound, so the driver's work does not
grow with the corpus. Scoring reads every whole text, by slices of a few MB; the weights (2 ** BITS floats) are
broadcast.

Defined cases: a null or empty text has only its length token and gets that score; a null label is no label; several
labels of one doc_id all count; a null doc_id can't be labelled and has held_out null; an empty table, or no labels of
one kind, gives the share of label 1 (0.5 without labels) as every score; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import kernels as K
from cinderlog.llm.common import labelled_sample, release_shuffles, remainder, table

BITS = 18
SAMPLE = 6_000
EPOCHS = 8
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 4.0, 1.0, 0.1, 0.0
#: Buckets of a token twice in a row, and of lengths.
TWICE, LENGTH = 0x7E91CE, 0x1E6674

LETTER = np.zeros(256, bool)
LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[0x21:0x7F] = True
SYMBOL &= ~LETTER


def features(data: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Borders of documents, feature numbers and values, of texts in one buffer."""
    n = len(off) - 1
    parts = [K.runs(mask[data], off) for mask in (LETTER, SYMBOL)]
    starts = np.concatenate([p[0] for p in parts])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.concatenate([p[1] for p in parts])[order]
    border = np.searchsorted(starts, off)
    doc = K.owner(border)
    h = K.span_hash(data, starts, ends)
    same = doc[1:] == doc[:-1]
    pair = K.mix(h[:-1] * np.uint64(3) + K.mix(h[1:]))
    pair[h[:-1] == h[1:]] = np.uint64(TWICE)
    size = np.floor(np.log2(np.diff(border) + 1.0)).astype(np.uint64)
    key = np.concatenate([h, pair[same], K.mix(size + np.uint64(LENGTH))])
    who = np.concatenate([doc, doc[1:][same], np.arange(n)]).astype(np.uint64)
    both, count = np.unique((who << np.uint64(bits)) | (key & np.uint64((1 << bits) - 1)), return_counts=True)
    at = np.searchsorted(both, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.add.reduceat(value * value, at[:-1])) if n else np.zeros(0)
    value /= np.repeat(norm, np.diff(at))
    return at, (both & np.uint64((1 << bits) - 1)).astype(np.int64), value


def train(border: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by per-coordinate follow-the-regularised-leader steps, one document a step, in a fixed order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    share = float(label.mean()) if len(label) else 0.5
    if not 0 < share < 1:
        return np.zeros(1 << bits, np.float32), 20.0 if share == 1 else -20.0 if len(label) else 0.0
    bias = float(np.log(share / (1 - share)))
    bias_n = 1.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(label)):
            f, x = feature[border[i] : border[i + 1]], value[border[i] : border[i + 1]]
            zi, ni = z[f], n[f]
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w @ x, -35, 35)))
            g = (p - label[i]) * x
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[f] = ni + g * g
            bias_n += (p - label[i]) ** 2
            bias -= 0.1 * (p - label[i]) / np.sqrt(bias_n)
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Learns quality from a bounded sample; the driver's memory for it is given back afterwards."""
    try:
        return _fit(docs, labels, learn, rows, bits)
    finally:
        release_shuffles(docs.sparkSession)


def _fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int, bits: int) -> tuple[np.ndarray, float]:
    """Executors hash the texts, the driver gets feature numbers and values."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off):
                at, f, v = features(*K.cut(data, off, a, b), bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("label")[a:b], K.lists(f.astype(np.int32), at, pa.int32()), K.lists(v.astype(np.float32), at, pa.float32())],
                    names=["doc_id", "label", "f", "v"],
                )

    sample = labelled_sample(docs, labels, "quality", learn, rows)
    rows_ = sample.mapInArrow(K.task(hashed), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, f array<int>, v array<float>").toArrow().combine_chunks()
    rows_ = rows_.sort_by([("doc_id", "ascending"), ("label", "ascending")])
    if not rows_.num_rows:
        return np.zeros(1 << bits, np.float32), 0.0
    f = rows_["f"].combine_chunks()
    v = rows_["v"].combine_chunks()
    border = np.concatenate([[0], np.cumsum(np.asarray(f.value_lengths()))])
    return train(border, np.asarray(f.flatten()).astype(np.int64), np.asarray(v.flatten()).astype(float), np.asarray(rows_["label"]).astype(float), bits)


def score(docs: DataFrame, weights: np.ndarray, bias: float, bits: int = BITS, keep_text: bool = False) -> DataFrame:
    """All columns of docs, without the text unless it's kept, with the score; needs a column text."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    keep = [c for c in docs.columns if c != "text" or keep_text]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b0 = shared.value
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off):
                at, f, v = features(*K.cut(data, off, a, b), bits)
                out = np.add.reduceat(w[f] * v, at[:-1]) + b0
                out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), pa.array(out)], names=[*keep, "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double"])
    return docs.select(*(c for c in docs.columns if c != "text"), "text").mapInArrow(K.task(scored), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    weights, bias = fit(docs, labels, remainder(5) != 0)
    return score(docs.select("doc_id", "text"), weights, bias).select(
        "doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality_classifier": op2_quality_classifier}
SQL: dict[str, str] = {}
