"""Language-model scoring by a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Every token is a customer of the restaurant of its context, the word before it (or a text's start), by its full hash: there
are as many restaurants as words. All context restaurants share one parent, the restaurant of words without context,
whose base is uniform over the V known words and one unknown. A table of a context restaurant is a customer of the parent.

A dish's seating enters a predictive probability only by its number of tables. Of n customers one alone has one table, so
that only pairs of two and more are sampled: t tables are drawn from their full conditional, which weighs them by the
generalised Stirling number and the t-th power of the weight of a new table; beyond EXACT customers by the ratios of these
numbers (rows to FAR customers, their limit law beyond). Predictive probabilities are those of the mean tables over the
samples of the last round, with totals of these means, so that they sum to one. Discounts come from the numbers of counts
of one and two. Draws are hashes of word, context and sweep.

The work is done on blocks of numbers, not on rows. Pairs are counted in a task and sent to the bucket of their context,
where they are sorted once: a bucket has whole restaurants, whose totals follow each sweep. Words have buckets of their
own (ranges of their hash), where the parent is seated. In a round each bucket of contexts tells those of words how many
tables its words have, and gets the parent's figures of just these words back; only pairs of two and more customers travel in rounds, as the tables of the others
never change. The seating is sampled in blocks: the parent's figures stay as they are within a round. A context of a large share of the tokens is split over several buckets
by word, and takes the totals of the others as they were a round before.

Texts to be scored take part in the first count with nothing, so that every bucket learns of every word it will be asked
for. The HEAD most frequent pairs are broadcast with their probabilities; other tokens go to their bucket, in PASSES parts
of the buckets, one after another. Sums come back to the block of texts that asked. What is broadcast or sent to the driver besides are the split
contexts, at most SPLIT for each bucket.

Defined cases: a null or empty text is its end token alone; a null doc_id is scored like others, and has held_out null in
the query, which doesn't learn from it; a null learn is false; rows of equal doc_id each get their own score, rows of
equal texts the same; an empty table gives no rows; without training tokens every word is unknown and has probability 1 of
the base; texts of any length are whole; other columns are not read. Texts and words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import kernels as K
from cinderlog.llm.common import drop_stash, release_shuffles, remainder, stash, table, text_hash, utf8_bytes

#: Most pairs whose probabilities are broadcast.
HEAD = 1 << 20
#: Bytes of text for each bucket, tokens that a task counts before it sends, and parts of the buckets when texts are scored.
BUCKET, GATHER, PASSES = 8 << 20, 3_000_000, 3
#: A context of more than a share of 1 / (SPLIT * buckets) of the tokens is split; one text in SAMPLE shows which.
SPLIT, SAMPLE = 4, 64
#: Customers of a dish up to which its tables are drawn from rows of Stirling numbers; beyond, from their ratios.
EXACT = 48
#: Customers up to which all, and some rows of ratios of Stirling numbers are held; tables in them.
WHOLE, FAR, WIDE = 512, 1 << 14, 2048
NORMAL = NormalDist()
#: Rounds before the last one with their sweeps, and sweeps of the last: not averaged, averaged.
ROUNDS, BURN, SAMPLES = (3, 2), 1, 4
CONCENTRATION = 1.0
END, START = (int(K.mix(np.array([x], np.uint64)).view(np.int64)[0]) for x in (0xE0D, 0x57A27))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with an end token after each text, the hashes of their contexts, and the texts' borders."""
    low = K.LOWER_BYTES[data]
    starts, ends, border = K.words(low, off)
    # one place more for each text's end
    place = np.arange(len(starts)) + K.owner(border)
    new_border = border + np.arange(len(off))
    word = np.full(int(new_border[-1]), END, np.int64)
    word[place] = K.span_hash(low, starts, ends).view(np.int64)
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[new_border[:-1]] = START
    return word, context, new_border


def _pair(word: np.ndarray, context: np.ndarray, mixed: np.ndarray | None = None) -> np.ndarray:
    """One hash of word and context; mixed: K.mix of context, where it is known."""
    return K.mix(word.view(np.uint64) + (K.mix(context.view(np.uint64)) if mixed is None else mixed))


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    return (K.mix(key + K.mix(np.array([salt], np.uint64))) >> np.uint64(11)).astype(float) * 2.0**-53


def _log_stirling(d: float, n_max: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t) of discount d: S(n + 1, t) = S(n, t - 1) + (n - t d) S(n, t)."""
    s = np.full((n_max + 1, n_max + 1), -np.inf)
    s[1, 1] = 0.0
    for n in range(1, n_max):
        t = np.arange(1, n + 2)
        stay = np.full(n + 1, -np.inf)
        stay[:n] = s[n, 1 : n + 1] + np.log(n - t[:n] * d)
        s[n + 1, 1 : n + 2] = np.logaddexp(s[n, 0 : n + 1], stay)
    return s


def draw_tables(n: np.ndarray, weight: np.ndarray, d: float, stirling: np.ndarray, rng: np.random.Generator | np.ndarray) -> np.ndarray:
    """Tables of dishes with n customers, where a new table weighs `weight` against n - t d of the old ones.

    rng can be a uniform number for each dish.
    """
    u = rng if isinstance(rng, np.ndarray) else rng.random(len(n))
    t = np.ones(len(n), np.int64)
    t[n == 0] = 0
    few = np.flatnonzero((n > 1) & (n <= EXACT))
    ratio = np.zeros((EXACT + 1, EXACT))  # S(n, t + 1) / S(n, t), for t from 1
    for k in range(2, EXACT + 1):
        ratio[k, 1:k] = np.exp(np.diff(stirling[k, 1 : k + 1]))
    # powers of two are the most that rows of one block have; products of weights up to 1e6 stay finite
    heavy = weight[few] > 1e6
    kind = np.where(heavy, 99, np.ceil(np.log2(np.arange(EXACT + 1).clip(1))).astype(np.uint8)[n[few]]).astype(np.uint8)
    few = few[np.argsort(kind, kind="stable")]
    border = np.cumsum(np.bincount(kind, minlength=100))
    for k in np.flatnonzero(np.diff(border, prepend=0)).tolist():
        wide = EXACT if k == 99 else min(1 << k, EXACT)
        rows = few[border[k - 1] : border[k]]
        for part in np.array_split(rows, max(1, len(rows) * wide // 100_000)):
            if k == 99:
                logits = stirling[n[part], 1:] + np.arange(1, EXACT + 1) * np.log(weight[part])[:, None]
                p = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            else:
                p = np.ones((len(part), wide))
                np.multiply(ratio[n[part], 1:wide], weight[part][:, None], out=p[:, 1:])
                np.cumsum(np.cumprod(p, 1, out=p), 1, out=p)
            t[part] = 1 + (u[part][:, None] * p[:, -1:] > p).sum(1)
    big = np.flatnonzero(n > EXACT)
    if len(big):
        t[big] = _draw_big(n[big], np.maximum(weight[big], 1e-300), d, u[big])
    return t


@functools.cache
def _ratios(d: float) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the rows, and rows of (t - 1) d S(n, t) / S(n, t - 1) for t from 2 (0 beyond n).

    All n to WHOLE are rows; beyond, rows are a fiftieth apart, to FAR, and t to WIDE.
    """
    steps = [WHOLE]
    while steps[-1] < FAR:
        steps.append(min(FAR, steps[-1] + max(1, steps[-1] // 50)))
    known = np.array([*range(1, WHOLE), *steps])
    rows = np.zeros((len(known), WIDE - 1))
    t = np.arange(2, WIDE + 1)
    of_t, of_below = d * t, d * (t - 1)
    r = np.zeros(WIDE - 1)  # S(n, t) / S(n, t - 1), from n = 1
    below, upper = np.zeros(WIDE - 1), np.zeros(WIDE - 1)  # 1 / the ratio one t below, as S(n, 0) = 0; the new numerator
    at = 1
    for n in range(1, FAR):
        m = min(n, WIDE - 1)  # t = 2 .. m + 1 exist for n + 1
        b, x, y = below[:m], upper[:m], r[:m]
        np.divide(1.0, y[: m - 1], out=b[1:])
        b[0] = 0.0
        np.subtract(n, of_t[:m], out=x)
        x *= y
        x += 1
        b += n
        b -= of_below[:m]
        np.divide(x, b, out=y)
        if n + 1 == known[at]:
            rows[at] = r * of_below
            at += 1
    return known, rows


def _draw_big(n: np.ndarray, w: np.ndarray, d: float, u: np.ndarray) -> np.ndarray:
    """draw_tables beyond EXACT: from the ratios of neighbouring terms S(n, t) w^t, in a window around their saddle point.

    The terms are those of a sum of Poisson(w / d) many Sibuya(d) sizes held at n: tilted by x^size so that its mean is n,
    the number of sizes has the saddle point's mean and variance. Rows between those of _ratios are interpolated in log n;
    beyond FAR, u(n, t) = log ratio n^d depends on t / n^d alone. Where t leaves the table (n > WHOLE, and t beyond WIDE or
    a quarter of n), the saddle point's normal law is drawn from: hundreds of tables, and the mean is off by about one.
    """
    nf = n.astype(float)
    # 1 - x, where w x (1 - x)^(d - 1) = n, by bisection of its logarithm
    lo, hi, wanted = np.full(len(n), -700.0), np.full(len(n), -1e-12), np.log(nf) - np.log(w)
    for _ in range(60):
        mid = (lo + hi) / 2
        more = np.log(-np.expm1(mid)) + (d - 1) * mid > wanted
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    y = np.exp(lo)
    mean = w / d * -np.expm1(d * lo)
    var = np.maximum(mean - nf * y / (1 - d * (1 - y)), 0) + 0.25
    reach = 10 + 8 * np.sqrt(var + 2)
    first = np.clip(np.floor(mean - reach), 1, n).astype(np.int64)
    last = np.clip(np.ceil(mean + reach), 1, n).astype(np.int64)
    out = np.ones(len(n), np.int64)
    smooth = (n > WHOLE) & ((last > WIDE) | (last > n // 4))
    normal = np.flatnonzero(smooth)
    if len(normal):
        z = np.array([NORMAL.inv_cdf(min(max(x, 1e-12), 1 - 1e-12)) for x in u[normal].tolist()])
        out[normal] = np.clip(np.rint(mean[normal] + z * np.sqrt(var[normal])), 1, n[normal]).astype(np.int64)
    rest = np.flatnonzero(~smooth)
    if not len(rest):
        return out
    known, rows = _ratios(d)
    width = last - first
    kind = np.ceil(np.log2(width[rest] + 1)).astype(np.int64)
    for k in np.unique(kind).tolist():
        chosen = rest[kind == k]
        span = np.arange(1, (1 << k) + 1)
        for part in np.array_split(chosen, max(1, (len(chosen) << k) // 1_000_000)):
            t = first[part][:, None] + span  # the ratio leads to t from t - 1
            live = t <= last[part][:, None]
            m = np.minimum(nf[part], FAR)
            i = np.minimum(np.searchsorted(known, m, "right") - 1, len(known) - 2)
            f = (np.log(m / known[i]) / np.log(known[i + 1] / known[i]))[:, None]
            shrink = (np.minimum(1.0, FAR / nf[part]) ** d)[:, None]
            place = np.clip(t * shrink - 2, 0, WIDE - 2)
            j = np.minimum(place.astype(np.int64), WIDE - 3)
            g = place - j
            with np.errstate(divide="ignore", invalid="ignore"):
                below, above = np.log(rows[i[:, None], j]), np.log(rows[i[:, None] + 1, j])
                value = np.where(f > 0, np.where(f < 1, (1 - f) * below + f * above, above), below)
                between = np.flatnonzero(shrink[:, 0] < 1)
                if len(between):
                    above = np.log(rows[-1][j[between] + 1])
                    value[between] = ((1 - g[between]) * value[between] + g[between] * above) * shrink[between]
                step = value - np.log(d * (t - 1)) + np.log(w[part])[:, None]
            logits = np.concatenate([np.zeros((len(part), 1)), np.cumsum(np.where(live, step, 0.0), 1)], 1)
            p = np.exp(logits - logits.max(1, keepdims=True, where=np.concatenate([np.ones((len(part), 1), bool), live], 1), initial=-np.inf))
            p[:, 1:] *= live
            p = np.cumsum(p, 1)
            out[part] = first[part] + (u[part][:, None] * p[:, -1:] > p).sum(1)
    return out


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


class Index:
    """Finds 64-bit hashes among sorted ones by their first bits, and then by a short walk; only the hashes travel."""

    def __init__(self, known: np.ndarray) -> None:
        self.known = known

    def __reduce__(self):
        return Index, (self.known,)

    @functools.cached_property
    def _places(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """By how much a hash is shifted, where its first bits begin, and the known ones with one more that ends every walk."""
        bits = max(1, min(24, int(np.log2(len(self.known) + 1)) + 2))
        shift = np.uint64(64 - bits)
        first = np.zeros(1 << bits, np.int32)
        np.cumsum(np.bincount((self.known >> shift).view(np.int64), minlength=1 << bits)[:-1], out=first[1:])
        return shift, first, np.append(self.known, np.uint64(2**64 - 1))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shift, first, known = self._places
        at = first[(keys >> shift).view(np.int64)]
        there = known[at]
        left = np.flatnonzero(there < keys)
        while len(left):
            at[left] += 1
            there[left] = known[at[left]]
            left = left[there[left] < keys[left]]
        return at, (there == keys) & (at < len(self.known))


@dataclass(frozen=True)
class Layout:
    """Where pairs and words are: the buckets of contexts and of words, and the split contexts with their parts."""

    buckets: int
    split: np.ndarray
    parts: np.ndarray

    def bucket(self, word: np.ndarray, context: np.ndarray, mixed: np.ndarray | None = None) -> np.ndarray:
        """mixed: K.mix of context, where it is known."""
        h = K.mix(context.view(np.uint64)) if mixed is None else mixed.copy() if len(self.split) else mixed
        at, met = _find(self.split, context)
        rows = np.flatnonzero(met)
        if len(rows):
            h[rows] = K.mix(h[rows] + K.mix(word[rows].view(np.uint64)) % self.parts[at[rows]].astype(np.uint64))
        return (h % np.uint64(self.buckets)).astype(np.int64)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        """Rises with the word's unsigned hash."""
        return ((word.view(np.uint64) >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)


@dataclass
class Model:
    """The layout, the figures of the whole model, and its stored tables: pairs by bucket, seating and words' figures of the last round."""

    layout: Layout
    tokens: int = 0
    words: int = 0
    d1: float = 0.5
    d0: float = 0.5
    #: Tables of all contexts, and tables of the parent.
    t_0: float = 0.0
    own_0: float = 0.0
    #: By split context, customers, tables of pairs of one customer, and all tables.
    split_n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    split_one: np.ndarray = field(default_factory=lambda: np.zeros(0))
    split_t: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def base(self) -> float:
        return 1.0 / (self.words + 1)

    def parent(self, tables: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Probabilities of words without context, by their customers and tables in the parent."""
        return (tables - self.d0 * own + (CONCENTRATION + self.d0 * self.own_0) * self.base) / (CONCENTRATION + self.t_0)


# rows of numbers as bytes: (bucket, kind, part, a, b, c, d, e), sorted before they come to a bucket's task

BLOCK = "bucket long, kind int, part long, a binary, b binary, c binary, d binary, e binary, x double, y double, z double"
_NAMES = [c.split()[0] for c in BLOCK.split(", ")]
PAIRS, MANY, SEATED, FIGURES, ASKED, HASHES, TEXTS, WORDS, FEW, OF_FEW, SHARED, SUMS = range(12)


def _block(bucket: int, kind: int, part: int = 0, *arrays: np.ndarray, sums: tuple[float, ...] = ()) -> tuple:
    blobs = [np.ascontiguousarray(x).tobytes() for x in arrays]
    return (int(bucket), kind, int(part), *blobs, *[None] * (5 - len(blobs)), *map(float, sums), *[None] * (3 - len(sums)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, *[pa.float64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in _NAMES)


def _groups(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of each bucket (place 0) or part (place 2), which come one after another."""
    return itertools.groupby(_rows(batches), lambda r: r[place])


def _by(blocks: DataFrame, column: str) -> DataFrame:
    return blocks.repartition(column).sortWithinPartitions(column, "kind", "part" if column == "bucket" else "bucket")


def _ints(blob: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(blob, kind)


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers of which SAMPLES times are whole and below 2 ** 31, as means of samples are, in four bytes; others as floats in eight."""
    times = numbers * float(SAMPLES)
    with np.errstate(invalid="ignore"):
        whole = times.astype(np.int32)
    return whole if (whole == times).all() and (whole / SAMPLES == numbers).all() else numbers.astype(float)


def _widened(blob: bytes, n: int) -> np.ndarray:
    return _ints(blob, "<i4") / SAMPLES if len(blob) == 4 * n else _ints(blob, "<f8").astype(float)


def _cut_runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and the border of each one's run."""
    new = np.ones(len(sorted_), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    at = np.flatnonzero(new)
    return sorted_[at], np.append(at, len(sorted_))


def layout_of(docs: DataFrame) -> Layout:
    """Buckets by the bytes of all texts; which contexts are split changes where work is done, and comes from a sample."""
    total = docs.agg(F.coalesce(F.sum(utf8_bytes(F.col("text"))), F.lit(0)).alias("n")).first()["n"]
    buckets = max(4, -(-total // BUCKET))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off):
                u, n = np.unique(tokens(*K.cut(data, off, a, b))[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n.astype(np.int64))], names=["u", "n"])

    sample = docs.where(F.pmod(F.xxhash64("text", F.lit(SAMPLE)), F.lit(SAMPLE)) == 0).select("text").mapInArrow(K.task(contexts), "u long, n long")
    counts = stash(sample.groupBy("u").agg(F.sum("n").alias("n")), "sample")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    # at most SPLIT * buckets contexts can have such a share
    found = sorted((r["u"], r["n"]) for r in counts.where(F.col("n") * SPLIT * buckets > whole).collect())
    drop_stash(counts)
    split = np.array([u for u, _ in found], np.int64)
    parts = np.ceil(np.array([n for _, n in found], float) / max(1, whole) * SPLIT * buckets).astype(np.int64)
    return Layout(buckets, split, parts)


def _token_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Slices of a column text: the batch, the slice, and its words, contexts and texts' borders."""
    for batch in batches:
        data, off = K.buffers(batch.column("text"))
        for a, b in K.slices(off):
            yield batch, a, b, *tokens(*K.cut(data, off, a, b))


def _sent(bucket: np.ndarray, context: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """For each bucket its contexts with the lengths of their runs, and the other columns in that order."""
    # by bucket, and in it by the first bits of the context: a context of two runs would be as good
    bits, last = int(bucket.max(initial=0)).bit_length(), (len(bucket) - 1).bit_length()
    key = (context.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(bits)
    if bits:
        key |= bucket.astype(np.uint64) << np.uint64(64 - bits)
    key &= ~np.uint64((1 << last) - 1)
    key |= np.arange(len(bucket), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << last) - 1)).view(np.int64)
    bucket, context, more = bucket[order], context[order], [x[order] for x in more]
    numbers, border = _cut_runs(bucket)
    for k, number in enumerate(numbers.tolist()):
        a, b = int(border[k]), int(border[k + 1])
        u, runs = _cut_runs(context[a:b])
        yield number, (u, np.diff(runs).astype(np.int32), *(x[a:b] for x in more))


def _counted(docs: DataFrame, layout: Layout) -> DataFrame:
    """Stored blocks: pairs by bucket, what they ask of words, and the totals of split contexts."""
    shared = docs.sparkSession.sparkContext.broadcast(layout)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        holds = 0

        def leave() -> pa.RecordBatch:
            word, context, learned = (np.concatenate(c) for c in zip(*held, strict=True))
            order, key = K.order(_pair(word, context))
            _, border = _cut_runs(key)
            n = np.add.reduceat(learned[order], border[:-1], dtype=np.int32)
            word, context = word[order[border[:-1]]], context[order[border[:-1]]]
            return _batch([_block(k, PAIRS, 0, u, run, w, c) for k, (u, run, w, c) in _sent(shared.value.bucket(word, context), context, word, n)])

        for batch, a, b, word, context, border in _token_arrays(batches):
            learn = np.asarray(batch.column("learn").fill_null(False))[a:b]
            held.append((word, context, np.repeat(learn, np.diff(border))))
            holds += len(word)
            if holds >= GATHER:
                yield leave()
                held.clear()
                holds = 0
        if held:
            yield leave()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, 0):
            parts = [(np.repeat(_ints(r[3]), _ints(r[4], "<i4")), _ints(r[5]), _ints(r[6], "<i4")) for r in rows]
            context, word, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            order, key = K.order(_pair(word, context))
            _, border = _cut_runs(key)
            n = np.add.reduceat(n[order].astype(np.int64), border[:-1])
            word, context = word[order[border[:-1]]], context[order[border[:-1]]]
            asked, a = K.distinct(word)
            sign = np.uint64(1 << 63)
            u, c = K.distinct(context.view(np.uint64) ^ sign)
            u = (u ^ sign).view(np.int64)
            bits = len(asked).bit_length()
            order, _ = K.order((c << bits | a) << (63 - bits - len(u).bit_length()))
            a, n = a[order], n[order]
            run = np.bincount(c, minlength=len(u))
            customers, one, more = (np.add.reduceat(x, _starts(run)) for x in (n, (n == 1).astype(np.int64), (n > 1).astype(np.int64)))
            out = [_block(bucket, PAIRS, 0, u, run.astype(np.int32), a.astype(np.int32), n, sums=((n == 1).sum(), (n == 2).sum(), len(n)))]
            # pairs of several customers, with what their contexts have besides
            k, some = np.flatnonzero(n > 1), np.flatnonzero(more)
            few, place = np.unique(a[k], return_inverse=True)
            out.append(_block(bucket, MANY, 0, u[some], np.stack([more[some], customers[some], one[some]]), place.astype(np.int32), n[k], asked[few]))
            out += _questions(shared.value, bucket, ASKED, asked, np.bincount(a, n > 0, len(asked)), np.bincount(a, n, len(asked)))
            out += _questions(shared.value, bucket, FEW, asked[few], np.bincount(place, minlength=len(few)))
            out += _split_totals(shared.value, bucket, u, customers, one, more)
            yield _batch(out)

    sent = docs.select("text", "learn").mapInArrow(K.task(count), BLOCK)
    return stash(_by(sent, "bucket").mapInArrow(K.task(settle), BLOCK), "counts", by="kind")


def _starts(run: np.ndarray) -> np.ndarray:
    return np.cumsum(run) - run


def _questions(layout: Layout, bucket: int, kind: int, asked: np.ndarray, tables: np.ndarray, customers: np.ndarray | None = None) -> list[tuple]:
    """What a bucket tells the buckets of words: its words with their tables, and customers."""
    if not len(asked):
        return []
    part, border = _cut_runs(layout.of_word(asked))
    cut = [(int(p), int(border[k]), int(border[k + 1])) for k, p in enumerate(part.tolist())]
    return [_block(bucket, kind, p, asked[a:b], _narrow(tables[a:b]), *(() if customers is None else (_narrow(customers[a:b]),))) for p, a, b in cut]


def _split_totals(layout: Layout, bucket: int, u: np.ndarray, *totals: np.ndarray) -> list[tuple]:
    at, met = _find(layout.split, u)
    return [_block(bucket, SHARED, 0, at[met], *(x[met].astype(float) for x in totals))] if met.any() else []


def _split_sums(blocks: DataFrame, layout: Layout, columns: int) -> list[np.ndarray]:
    """Sums over all buckets of what they tell of the split contexts."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            at = _ints(r[3])
            for c in range(columns):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), c)), pa.array(_ints(r[4 + c], "<f8"))], names=["at", "c", "v"])

    out = [np.zeros(len(layout.split)) for _ in range(columns)]
    if len(layout.split):
        for r in blocks.where(F.col("kind") == SHARED).mapInArrow(K.task(flat), "at long, c long, v double").groupBy("at", "c").agg(F.sum("v").alias("v")).collect():
            out[r["c"]][r["at"]] = r["v"]
    return out


def _words(blocks: list[DataFrame], model: Model | None, salt: int = 0, samples: int = 1) -> DataFrame:
    """Stored blocks: for each question the words' tables of all contexts, their own tables in the parent and customers; and sums.

    Without a model, at first, there are no draws: a word has one table of its own, and the words are kept with the tables
    of their pairs of one customer. Questions of all words are answered where they are among the blocks, beside those of FEW.
    """
    shared = blocks[0].sparkSession.sparkContext.broadcast((model, _log_stirling(model.d0) if model else None))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, stirling = shared.value
        for part, rows in _groups(batches, 2):
            found, _ = _kinds(rows, SUMS)
            out = []
            few, asked = ([(r[0], _ints(r[3], "<u8"), _widened(r[4], len(r[3]) // 8), r[5]) for r in found.get(kind, ())] for kind in (FEW, ASKED))
            join = lambda x, c, t: np.concatenate([y[c] for y in x] or [np.zeros(0, t)])
            if m is None:
                word, at = np.unique(join(asked, 1, np.uint64), return_inverse=True)
                tables = np.bincount(at, join(asked, 2, float), len(word))
                customers = np.bincount(at, np.concatenate([_widened(x[3], len(x[1])) for x in asked]), len(word)).astype(np.int64)
                own = (tables > 0).astype(float)
                more = np.bincount(np.searchsorted(word, join(few, 1, np.uint64)), join(few, 2, float), len(word))
                out.append(_block(-1, WORDS, part, word, tables - more, customers))
                asked = []
            else:
                (kept,) = found[WORDS]
                word, one, customers = _ints(kept[3], "<u8"), _ints(kept[4], "<f8"), _ints(kept[5])
                tables = one + np.bincount(np.searchsorted(word, join(few, 1, np.uint64)), join(few, 2, float), len(word))
                weight = np.full(len(word), (CONCENTRATION + m.d0 * m.own_0) * m.base)
                whole = np.rint(tables).astype(np.int64)
                own = sum(draw_tables(whole, weight, m.d0, stirling, _uniform(word, salt + k)).astype(float) for k in range(samples)) / samples
            # at the end all are told, those of FEW apart
            for kind, questions in ((FIGURES, asked), (OF_FEW, few)) if asked else ((FIGURES, few),):
                for number, w, *_ in questions:
                    at = np.searchsorted(word, w)
                    out.append(_block(number, kind, part, _narrow(tables[at]), _narrow(own[at]), _narrow(customers[at]), sums=(len(at),)))
            out.append(_block(-1, SUMS, 0, sums=(tables.sum(), own.sum(), customers.sum())))
            out.append(_block(-1, SUMS, 1, sums=((customers > 0).sum(), (tables == 1).sum(), (tables == 2).sum())))
            yield _batch(out)

    return stash(_by(functools.reduce(DataFrame.unionByName, blocks), "part").mapInArrow(K.task(answer), BLOCK), "words")


def _sums(blocks: DataFrame, kind: int, part: int = 0) -> tuple[float, float, float]:
    r = blocks.where((F.col("kind") == kind) & (F.col("part") == part)).agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in "xyz")).first()
    return r["x"], r["y"], r["z"]


class Bucket:
    """The pairs of a bucket (all, or those of several customers), the figures of its words, and the tables of its pairs."""

    def __init__(self, rows: dict[int, list[tuple]], model: Model) -> None:
        self.model = model
        (pairs,) = rows[PAIRS] if PAIRS in rows else rows[MANY]
        self.context, self.a, self.n, self.asked = _ints(pairs[3]), _ints(pairs[5], "<i4").astype(np.int64), _ints(pairs[6]), _ints(pairs[7] or b"", "<u8")
        if PAIRS in rows:
            self.asked = np.concatenate([_ints(r[3], "<u8") for r in rows[ASKED]])
            self.run = _ints(pairs[4], "<i4").astype(np.int64)
            self.customers, self.one = np.add.reduceat(self.n, _starts(self.run)).astype(float), np.zeros(len(self.run))
        else:
            self.run, customers, one = _ints(pairs[4]).reshape(3, -1)
            self.customers, self.one = customers.astype(float), one.astype(float)
        told = [np.concatenate([_widened(r[c], int(r[8])) for r in rows.get(FIGURES, ())] or [np.zeros(0)]) for c in (3, 4, 5)]
        self.p0, self.word_customers = model.parent(*told[:2]), told[2]
        self.of = np.repeat(np.arange(len(self.run)), self.run)
        self.many = np.flatnonzero(self.n > 1)
        self.t = np.minimum(self.n, 1).astype(float)
        if SEATED in rows:
            self.t[self.many] = _widened(rows[SEATED][0][3], len(self.many))
        self.split, met = _find(model.layout.split, self.context)
        self.shared = np.flatnonzero(met)
        self.split = self.split[self.shared]
        # what the other buckets have of a split context
        self.elsewhere = model.split_t[self.split] - self._own_totals()[self.shared]
        self.customers[self.shared] = model.split_n[self.split]

    def _own_totals(self) -> np.ndarray:
        return self.one + (np.add.reduceat(self.t, _starts(self.run)) if len(self.run) else 0.0)

    def totals(self) -> np.ndarray:
        """Tables by context."""
        out = self._own_totals()
        out[self.shared] += self.elsewhere
        return out

    def sweep(self, salt: int, stirling: np.ndarray, key: np.ndarray) -> None:
        m = self.many
        if len(m):
            weight = (CONCENTRATION + self.model.d1 * self.totals()[self.of[m]]) * self.p0[self.a[m]]
            self.t[m] = draw_tables(self.n[m], weight, self.model.d1, stirling, _uniform(key, salt))

    def probability(self) -> np.ndarray:
        """Of all pairs, also those that were never met."""
        share = (CONCENTRATION + self.model.d1 * self.totals()) / (CONCENTRATION + self.customers)
        return (self.n - self.model.d1 * self.t) / (CONCENTRATION + self.customers[self.of]) + share[self.of] * self.p0[self.a]


def _kinds(rows: Iterator[tuple], until: int = HASHES) -> tuple[dict[int, list[tuple]], Iterator[tuple]]:
    """The rows of a bucket by kind, and those from a kind on as they come."""
    out: dict[int, list[tuple]] = {}
    for r in rows:
        if r[1] >= until:
            return out, itertools.chain([r], rows)
        out.setdefault(r[1], []).append(r)
    return out, iter(())


def _seat(counts: DataFrame, seated: DataFrame | None, words: DataFrame, model: Model, salt: int, burn: int, samples: int) -> DataFrame:
    """Stored blocks: seating after the sweeps (the mean of samples, if any), and what is told of it."""
    shared = counts.sparkSession.sparkContext.broadcast((model, _log_stirling(model.d1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, stirling = shared.value
        for number, rows in _groups(batches, 0):
            b = Bucket(_kinds(rows)[0], m)
            key = _pair(b.asked[b.a[b.many]].view(np.int64), b.context[b.of[b.many]])
            mean = np.zeros(len(b.many))
            for k in range(burn + samples):
                b.sweep(salt + k, stirling, key)
                if k >= burn:
                    mean += b.t[b.many] / samples
            if samples:
                b.t[b.many] = mean
            out = [_block(number, SEATED, 0, _narrow(b.t)), *_questions(m.layout, number, FEW, b.asked, np.bincount(b.a, b.t, len(b.asked)))]
            yield _batch(out + _split_totals(m.layout, number, b.context, b._own_totals() - b.one))

    blocks = [counts.where(F.col("kind") == MANY), words.where(F.col("kind") == FIGURES)] + ([] if seated is None else [seated.where(F.col("kind") == SEATED)])
    return stash(_by(functools.reduce(DataFrame.unionByName, blocks), "bucket").mapInArrow(K.task(run), BLOCK), "seated")


def train(docs: DataFrame) -> tuple[Model, dict[str, DataFrame]]:
    """The model of the rows of docs (text, learn) whose learn holds, with its stored blocks; it knows the words of all rows."""
    spark = docs.sparkSession
    layout = layout_of(docs)
    counts = _counted(docs, layout)
    release_shuffles(spark)
    of_kind = lambda df, kind: df.where(F.col("kind") == kind)
    questions = of_kind(counts, ASKED)
    first = figures = _words([questions, of_kind(counts, FEW)], None)
    release_shuffles(spark)
    once, twice, _ = _sums(counts, PAIRS)
    t_0, own_0, customers = _sums(first, SUMS)
    known, of_one, of_two = _sums(first, SUMS, 1)
    model = Model(layout, int(customers), int(known), _discount(int(once), int(twice)), _discount(int(of_one), int(of_two)), t_0, own_0)
    model.split_n, model.split_one, more = _split_sums(counts, layout, 3)
    model.split_t = model.split_one + more
    seated, salt = None, 1
    for sweeps, samples in (*((k, 0) for k in ROUNDS), (BURN, SAMPLES)):
        now = _seat(counts, seated, figures, model, salt, sweeps, samples)
        told = _words([of_kind(first, WORDS), of_kind(now, FEW), *([questions] if samples else [])], model, salt, max(1, samples))
        model.t_0, model.own_0, _ = _sums(told, SUMS)
        model.split_t = model.split_one + _split_sums(now, layout, 1)[0]
        for gone in (seated, None if figures is first else figures):
            if gone is not None:
                drop_stash(gone)
        seated, figures, salt = now, told, salt + sweeps + samples
        release_shuffles(spark)
    drop_stash(first)
    return model, {"counts": counts, "seated": seated, "figures": figures}


def _of_buckets(tables: dict[str, DataFrame]) -> DataFrame:
    kinds = {"counts": (PAIRS, ASKED), "seated": (SEATED,), "figures": (FIGURES,)}
    # of what was asked only the words
    told = {c: F.when(F.col("kind") != ASKED, F.col(c)).alias(c) for c in ("b", "c")}
    return functools.reduce(DataFrame.unionByName, [tables[t].where(F.col("kind").isin(*k)).select(*(told.get(c, c) if t == "counts" else c for c in _NAMES)) for t, k in kinds.items()])


def _base(customers: np.ndarray, model: Model) -> np.ndarray:
    return np.log10((customers + 0.1) / (model.tokens + 0.1 * (model.words + 1)))


@dataclass
class Head:
    """The model with its most frequent pairs: their hashes, the logarithms of their probabilities, and their words' customers."""

    model: Model
    keys: Index
    log_p: np.ndarray
    customers: np.ndarray

    @functools.cached_property
    def base(self) -> np.ndarray:
        return _base(self.customers, self.model)


def predictive(model: Model, tables: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """word, context, n, the logarithm to 10 of the probability, and the word's customers, of pairs met at least so often (twice or more)."""
    told = tables["figures"].where(F.col("kind") == OF_FEW).withColumn("kind", F.lit(FIGURES))
    blocks = tables["counts"].where(F.col("kind") == MANY).unionByName(tables["seated"].where(F.col("kind") == SEATED)).unionByName(told)
    shared = tables["counts"].sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 0):
            found, _ = _kinds(rows)
            b = Bucket(found, shared.value)
            k = np.flatnonzero(b.n >= least)
            columns = [b.asked[b.a[k]].view(np.int64), b.context[b.of[k]], b.n[k], np.log10(b.probability()[k]), b.word_customers[b.a[k]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "context", "n", "p", "customers"])

    return _by(blocks, "bucket").mapInArrow(K.task(run), "word long, context long, n long, p double, customers double")


def _least(counts: DataFrame, most: int) -> int:
    """The least count (2 at least) with which at most `most` pairs remain, by a histogram of eight steps for each doubling."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            n = _ints(r[6])
            step, at, k = np.unique(np.floor(np.log2(np.maximum(n, 1)) * 8).astype(np.int64), return_inverse=True, return_counts=True)
            least = np.full(len(step), 2**62)
            np.minimum.at(least, at, np.maximum(n, 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(k.astype(np.int64)), pa.array(least)], names=["step", "k", "least"])

    steps = counts.where(F.col("kind") == MANY).mapInArrow(K.task(run), "step long, k long, least long")
    out, left = 2**62, most
    for r in steps.groupBy("step").agg(F.sum("k").alias("k"), F.min("least").alias("least")).orderBy(F.desc("step")).collect():
        left -= r["k"]
        if left < 0:
            break
        out = r["least"]
    return max(out, 2)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs (doc_id, text, learn).

    The model learns from the rows whose learn holds; others are scored by it.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", "learn")
    model, tables = train(docs)
    head = predictive(model, tables, _least(tables["counts"], HEAD)).select("word", "context", "p", "customers").toArrow().combine_chunks()
    pair = _pair(*(np.asarray(head[c].combine_chunks()) if head.num_rows else np.zeros(0, np.int64) for c in ("word", "context")))
    order = np.argsort(pair)
    release_shuffles(spark)
    log_p, customers = (np.asarray(head[c].combine_chunks())[order] if head.num_rows else np.zeros(0) for c in ("p", "customers"))
    shared = spark.sparkContext.broadcast(Head(model, Index(pair[order]), log_p, customers.astype(np.int32 if customers.max(initial=0) < 1 << 31 else np.int64)))
    own = {"doc_id": docs.schema["doc_id"].dataType.simpleString()} | dict.fromkeys(("th", "n_tokens", "n_known"), "long") | dict.fromkeys(("base_score", "score"), "double")
    own_schema = ", ".join(f"{c} {t}" for c, t in own.items())
    names = [*own, *_NAMES]

    def beside(ids: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
        none = [pa.nulls(len(rows), t) for t in (ids, *[pa.int64()] * 3, *[pa.float64()] * 2)]
        return pa.RecordBatch.from_arrays([*none, *_batch(rows).columns], names=names)

    def send(part: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, keys, p, base = (head := shared.value).model, head.keys, head.log_p, head.base
            held: list[tuple[np.ndarray, ...]] = []
            seen: dict[int, int] = {}
            holds = 0
            sources = itertools.count(TaskContext.get().partitionId() << 32)

            def leave() -> Iterator[pa.RecordBatch]:
                word, context, bucket, text = (np.concatenate(c) for c in zip(*held, strict=True))
                if len(word):
                    source = next(sources)
                    text = text.astype(np.uint16 if len(seen) <= 1 << 16 else np.uint32)
                    rows = [_block(k, TEXTS, source, *arrays, sums=(len(seen),)) for k, arrays in _sent(bucket, context, word, text)]
                    yield beside(ids, [_block(rows[0][0], HASHES, source, np.array(list(seen), np.int64)), *rows])
                held.clear()
                seen.clear()

            for batch, a, b, word, context, border in _token_arrays(batches):
                ids = batch.column("doc_id").type
                n, doc = b - a, K.owner(border)
                mixed = K.mix(context.view(np.uint64))
                bucket = m.layout.bucket(word, context, mixed)
                fresh, number = np.zeros(n, bool), np.zeros(n, np.int64)
                for i, h in enumerate(batch.column("th")[a:b].to_pylist()):
                    fresh[i] = h not in seen
                    number[i] = seen.setdefault(h, len(seen))
                # frequent pairs count in the first part, in which all tokens are looked up
                left = np.flatnonzero((bucket % PASSES == part) & fresh[doc])
                if part == 0:
                    near, met = keys.find(_pair(word, context, mixed))
                    hit = np.flatnonzero(met)
                    sums = [np.bincount(doc[hit], x, n).astype(float) for x in (base[near[hit]], p[near[hit]])] if len(keys.known) else [np.zeros(n)] * 2
                    columns = [batch.column("doc_id")[a:b], batch.column("th")[a:b], pa.array(np.diff(border)), pa.array(np.bincount(doc[hit], minlength=n)), *map(pa.array, sums)]
                    none = _batch([_block(i % m.layout.buckets, SUMS) for i in range(a, b)])
                    yield pa.RecordBatch.from_arrays([*columns, *none.columns], names=names)
                    left = left[~met[left]]
                else:
                    left = left[~keys.find(_pair(word[left], context[left], mixed[left]))[1]]
                held.append((word[left], context[left], bucket[left], number[doc[left]]))
                holds += len(left)
                if holds >= GATHER:
                    yield from leave()
                    holds = 0
            if held:
                yield from leave()

        return run

    def whole_rows(batches: Iterator[pa.RecordBatch], ready: list[pa.RecordBatch], ids: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """The blocks; the rows of texts are put aside."""
        for batch in batches:
            ids[:] = [batch.column("doc_id").type]
            whole = batch.filter(batch.column("th").is_valid())
            if whole.num_rows:
                ready.append(whole)
            yield batch.filter(batch.column("th").is_null()).select(_NAMES)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.model
        ready, ids = [], []
        for _, rows in _groups(whole_rows(batches, ready, ids), 0):
            found, asking = _kinds(rows)
            b, out = None, []
            for r in asking:
                if r[1] == HASHES:
                    out.append(_block(r[2], HASHES, 0, _ints(r[3])))
                elif r[1] == TEXTS:
                    if b is None:
                        b = Bucket(found, m)
                        probability = np.log10(b.probability())
                        base, known = _base(b.word_customers, m), b.word_customers > 0
                        keys, words = b.of << 32 | b.a, Index(b.asked)
                    u, length, w = _ints(r[3]), _ints(r[4], "<i4"), _ints(r[5], "<u8")
                    t = _ints(r[6], "<u2" if r[8] <= 1 << 16 else "<u4")
                    # every pair of a text was counted, if only with nothing
                    at, (a, _) = np.searchsorted(b.context, u), words.find(w)
                    k = np.searchsorted(keys, np.repeat(at, length) << 32 | a)
                    if r[8] <= 4 * len(t):
                        of = np.flatnonzero(np.bincount(t))
                        sums = [np.bincount(t, x)[of] for x in (known[a], base[a], probability[k])]
                    else:
                        of, t = np.unique(t, return_inverse=True)
                        sums = [np.bincount(t, x, len(of)) for x in (known[a], base[a], probability[k])]
                    out.append(_block(r[2], TEXTS, 0, of.astype(np.uint32), sums[0].astype(np.uint32), *sums[1:]))
            if out:
                yield beside(ids[0], out)
            yield from ready
            ready.clear()
        yield from ready

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, ids = [], []
        for _, rows in _groups(whole_rows(batches, ready, ids), 0):
            th, *sums = [np.zeros(0)] * 4
            for r in rows:
                if r[1] == HASHES:
                    th = _ints(r[3])
                    sums = [np.zeros(len(th)) for _ in range(3)]
                elif r[1] == TEXTS:
                    for x, c, kind in zip(sums, (4, 5, 6), ("<u4", "<f8", "<f8"), strict=True):
                        x[_ints(r[3], "<u4")] += _ints(r[c], kind)
            if len(th):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(th), ids[0]), pa.array(th), pa.nulls(len(th), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[*own])
            yield from (x.select([*own]) for x in ready)
            ready.clear()
        yield from (x.select([*own]) for x in ready)

    plain = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    of_buckets = _of_buckets(tables)
    found = []
    for part in range(PASSES):
        sent = plain.mapInArrow(K.task(send(part)), f"{own_schema}, {BLOCK}")
        mine = of_buckets.where(F.pmod("bucket", F.lit(PASSES)) == part).select(*(F.lit(None).cast(t).alias(c) for c, t in own.items()), *_NAMES)
        looked = _by(sent.unionByName(mine), "bucket").mapInArrow(K.task(look), f"{own_schema}, {BLOCK}")
        found.append(stash(_by(looked, "bucket").mapInArrow(K.task(add), own_schema), "scores"))
        release_shuffles(spark)
    rows = found[0].where("n_tokens is not null")
    # a text that several tasks have met was summed in each
    mean = lambda c: F.sum(c) / F.count("*")
    tails = [x.where("n_tokens is null").groupBy("th").agg(mean("n_known").cast("long").alias("k"), mean("base_score").alias("b"), mean("score").alias("s")) for x in found]
    tail = functools.reduce(DataFrame.unionByName, tails).groupBy("th").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("s").alias("s"))
    zero = F.lit(0.0)
    out = rows.join(tail, "th", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("s", zero)).alias("score"),
    )
    out = stash(out, "scored")
    for gone in (*tables.values(), *found):
        drop_stash(gone)
    shared.destroy()
    return out


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity of all tokens of a scored table, by the model and by the base."""
    total = F.sum("n_tokens")
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / total).alias("perplexity"), F.pow(F.lit(10.0), -F.sum("base_score") / total).alias("base_perplexity"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(10) != 0).alias("learn"))
    return score(docs).select("doc_id", (remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
SQL: dict[str, str] = {}
