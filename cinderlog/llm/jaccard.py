"""N-gram Jaccard join over count vectors: R-trees of group counts bound the overlap, exact sets decide.

A text's set is that of its distinct shingles. Shingles are hashed into groups, and a set becomes the point of its group
counts. Two sets of sizes a and b link only if their overlap is at least 85 (a + b) / 185, so they differ in at most
r = 15 (a + b) / 185 shingles; the overlap itself is at most the sum of coordinate minima.

The space is dealt out before trees are built, without loss, by an exact partition of signatures: in a window of sizes,
shingles are dealt to m > r blocks, so that linked sets agree exactly in at least m - r of them. A cell is all sets with
the same shingles in one block; only sets that share a cell are compared. Blocks of few shingles are sparse, and a set
has no cell for them: m - r is more than nearly all sets have sparse blocks, so that one that agrees is dense. A set with
more of them is dealt anew by another seed, and after SEEDS of those meets its likes by a prefix (its shingles of least
hash, as many as it may lack and one more). So no set is keyed by an empty block, and unrelated texts share few cells.

Keys travel to their bucket in one shuffle; those that several sets of a batch share are found before it, and a hot key
comes once from each batch. Equal sets are one class. In each cell the class that shares most cells is the hub; each
class is first compared with its best hub, by the bound and then by the exact sets, which joins groups of near copies by a star.
Sets are larger than their texts, so points are stored for all classes but sets only for those that the bound leaves. Cells that still
hold several components are indexed by an R-tree of their points (beyond CHUNK shingles, by pairs of parts; up to LEAF
points are a leaf of their own), whose nodes are cut by the bound; of the pairs that survive the task returns a forest,
less than one a member. A component of links and these candidates holds whatever its members may link with. Where it is
of several components of links, its sets come to one task (or to one for each pair of parts), which goes through the pairs
that survive the bound, verifies those between different components and joins them as it goes: again a forest. Components are then those of all
verified links; no link between different components is lost, and a pair inside a component needs no check.

Defined cases: a null or empty text, or one of white space, has no shingles and is alone (component_id is its doc_id);
rows of equal doc_id are told apart by their texts; repeated rows are equal sets; a null doc_id takes part, and the
component is named by the least doc_id that isn't null; of equally good hubs the one of the largest class hash is taken,
which changes no component; an empty table gives no rows; texts of any length are whole; other columns are not read.
Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import kernels as K
from cinderlog.llm.common import drop_stash, release_shuffles, small, stash, table, text_hash
from cinderlog.llm.components import components

WORDS = 4
NUM, DEN = 85, 100
#: Groups of the points that R-trees index.
GROUPS = 256
#: Points of a leaf, and shingles of a part of a cell.
LEAF, CHUNK = 16, 1 << 19
#: Ways to deal blocks before a set of too many sparse blocks is keyed by its prefix.
SEEDS = 3
#: Largest over least size in a window.
WINDOW = 1.5
#: Keys that a task gathers before it looks for shared ones.
GATHERED = 1 << 19
#: Bytes of the pairs whose sets are compared in a round; below what may be broadcast.
ROUND_BYTES = 40 << 20


def shingles(data: np.ndarray, off: np.ndarray, size: int = WORDS) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes; fewer words than size are one shingle."""
    low = K.LOWER_BYTES[data]
    starts, ends, border = K.words(low, off)
    h = K.span_hash(low, starts, ends)
    rolled = h.copy()
    n = len(h)
    for k in range(1, min(size, n)):
        rolled[: n - k] = K.mix(rolled[: n - k] * np.uint64(0x9E3779B97F4A7C15) + h[k:])
    out = []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = K.mix(x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def needed(a, b, num: int = NUM, den: int = DEN):
    """Least overlap with which sets of sizes a and b link."""
    return -(-(num * (a + b)) // (den + num))


@functools.cache
def window(number: int, num: int, den: int) -> tuple[int, int]:
    """Least and largest size of a window; sizes that can link share at least one."""
    if not number:
        return 1, 1
    # the least size whose largest partner the window before doesn't hold
    low = -(-num * (window(number - 1, num, den)[1] + 1) // den)
    low = max(low, window(number - 1, num, den)[0] + 1)
    return low, max(low, int(low * WINDOW))


@functools.cache
def scheme(number: int, num: int, den: int) -> tuple[int, int, int] | None:
    """Blocks, how many may be sparse, and the largest count of a sparse one; None where only equal sets link."""
    low, top = window(number, num, den)
    r = 2 * top * (den - num) // (den + num)
    if not r:
        return None
    for few in (1, 0):
        for m in range(r + 2, int(1.5 * r) + 8):
            share = math.exp(-low / m) * (1 + low / m * few)
            if m - r - 1 >= m * share + 2 * math.sqrt(m * share * (1 - share)):
                return m, m - r - 1, few
    return r + 2, 1, 0


@functools.cache
def windows(n: int, num: int, den: int) -> tuple[int, ...]:
    """Numbers of the windows that hold sets of n shingles."""
    low, high = 0, 1
    while window(high, num, den)[0] <= n:
        high *= 2
    while low < high:  # the first window that begins beyond n
        mid = (low + high) // 2
        low, high = (mid + 1, high) if window(mid, num, den)[0] <= n else (low, mid)
    first = low
    while first and window(first - 1, num, den)[1] >= n:
        first -= 1
    return tuple(k for k in range(first, low) if scheme(k, num, den))


def cells(u: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Keys of the cells of a set: a hash of the shingles of a block, the block, the window and the seed."""
    keys = [np.zeros(0, np.uint64)]
    for number in windows(len(u), num, den):
        m, spare, few = scheme(number, num, den)
        for seed in range(SEEDS):
            tag = number * (SEEDS + 1) + seed
            mixed = K.mix(u + np.uint64(tag + 1))
            block = (mixed % np.uint64(m)).astype(np.int64)
            total = np.zeros(m, np.uint64)
            np.add.at(total, block, K.mix(mixed))
            which = np.flatnonzero(np.bincount(block, minlength=m) > few)
            keys.append(K.mix(total[which] + K.mix(which.astype(np.uint64) + np.uint64(tag << 32))))
            if m - len(which) <= spare:
                break
        else:
            mixed = np.sort(K.mix(u + np.uint64(tag + 2)))
            keys.append(K.mix(mixed[: len(u) + 1 + -num * len(u) // den]))
    return np.concatenate(keys)


def points(u: np.ndarray, border: np.ndarray) -> np.ndarray:
    """A row of group counts for each of the sets end to end in u."""
    group = (u >> np.uint64(7)).astype(np.int64) & (GROUPS - 1)
    return np.bincount(K.owner(border) * GROUPS + group, minlength=GROUPS * (len(border) - 1)).reshape(-1, GROUPS)


def packed(point: np.ndarray) -> bytes:
    """The counts in as few bytes as the largest needs."""
    return point.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if point.max() <= np.iinfo(t).max)).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    """packed() points of one width or several, as one table of the widest."""
    if len({len(r) for r in rows}) > 1:
        return np.stack([np.frombuffer(r, f"u{len(r) // GROUPS}").astype(np.int64) for r in rows])
    return np.frombuffer(b"".join(rows), f"u{len(rows[0]) // GROUPS}").reshape(-1, GROUPS)


def _signature(u: np.ndarray) -> int:
    """0 for a set without shingles."""
    return int(K.mix(np.array([K.mix(u).sum(dtype=np.uint64) + np.uint64(len(u))], np.uint64)).view(np.int64)[0]) if len(u) else 0


class Shared:
    """Keys of a bucket as they come: the rows (key, sig) of those that more than one class has.

    Holds each key once with its first class, however many classes have it.
    """

    def __init__(self) -> None:
        self.key, self.sig, self.told = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key, sig = np.concatenate([self.key, key]), np.concatenate([self.sig, sig])
        told = np.concatenate([self.told, np.zeros(len(key) - len(self.told), bool)])
        order = np.argsort(key, kind="stable")  # the one that is held comes first
        key, sig, told = key[order], sig[order], told[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        other = sig != sig[at][of]
        shared = told[at] | (np.bincount(of, other, len(at)) > 0)
        out = other | (first & shared[of] & ~told)
        self.key, self.sig, self.told = key[at], sig[at], shared
        return key[out], sig[out]


def _sets(docs: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """Stored: doc_id, th, n, sig (0 without shingles) of all rows, and sig and key of all cells of several classes (key is null in the others)."""
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.select("doc_id").schema["doc_id"].dataType
    names = ["doc_id", "th", "n", "sig", "bucket", "keys", "sigs", "done"]

    def blobs(key: np.ndarray, sig: np.ndarray, ids: pa.DataType, done: bool) -> Iterator[pa.RecordBatch]:
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, sig = key[order], sig[order]
        border = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(border))
        if not len(full):
            return
        cut = lambda x: pa.array([x[border[k] : border[k + 1]].tobytes() for k in full.tolist()], pa.binary())
        none = [pa.nulls(len(full), t) for t in (ids, pa.int64(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(full, pa.int32()), cut(key), cut(sig), pa.array(np.full(len(full), done))], names=names)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sig, held, seen = [], [], 0, set()

        def leave(ids: pa.DataType) -> Iterator[pa.RecordBatch]:
            k, s = np.concatenate(key), np.concatenate(sig)
            bucket = Shared()
            # what is shared here is known already, and only one row of it goes to meet the others
            yield from blobs(*bucket.add(k, s), ids, True)
            yield from blobs(bucket.key, bucket.sig, ids, False)

        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            ids = batch.column("doc_id").type
            for a, b in K.slices(off):
                ns, sigs = [], []
                for u in shingles(*K.cut(data, off, a, b), size):
                    ns.append(len(u))
                    sigs.append(_signature(u))
                    if len(u) and sigs[-1] not in seen:
                        seen.add(sigs[-1])
                        key.append(cells(u, num, den))
                        sig.append(np.full(len(key[-1]), sigs[-1], np.int64))
                        held += len(key[-1])
                at = pa.array(np.arange(a, b) % buckets, pa.int32())
                none = pa.nulls(b - a, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("th")[a:b], pa.array(ns, pa.int64()), pa.array(sigs, pa.int64()), at, none, none, pa.nulls(b - a, pa.bool_())], names=names)
                if held >= GATHERED:
                    yield from leave(ids)
                    key, sig, held, seen = [], [], 0, set()
                    K.release()
        if key:
            yield from leave(ids)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, key, sig, held = Shared(), [], [], 0

        def rows(k: np.ndarray, s: np.ndarray, ids: pa.DataType) -> Iterator[pa.RecordBatch]:
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(k), ids), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(s), pa.array(k.view(np.int64))], names=[*names[:4], "key"])

        for batch in batches:
            ids = batch.column("doc_id").type
            plain = batch.filter(batch.column("n").is_valid())
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([*(plain.column(c) for c in names[:4]), pa.nulls(plain.num_rows, pa.int64())], names=[*names[:4], "key"])
            others = batch.filter(batch.column("n").is_null())
            for done in (True, False):
                part = others.filter(pa.compute.equal(others.column("done"), done))
                k, s = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("sigs", np.int64)))
                if done:
                    yield from rows(k, s, ids)
                else:
                    key.append(k)
                    sig.append(s)
                    held += len(k)
            if held >= GATHERED:
                yield from rows(*bucket.add(np.concatenate(key), np.concatenate(sig)), ids)
                key, sig, held = [], [], 0
        if key:
            yield from rows(*bucket.add(np.concatenate(key), np.concatenate(sig)), ids)

    kind = id_type.simpleString()
    rows = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    sent = rows.mapInArrow(K.task(made), f"doc_id {kind}, th long, n long, sig long, bucket int, keys binary, sigs binary, done boolean")
    return stash(sent.repartition("bucket").mapInArrow(K.task(met), f"doc_id {kind}, th long, n long, sig long, key long"), "sets")


class RTree:
    """A packed R-tree of count points: halves along the widest coordinate; nodes keep coordinate maxima and the least size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        self.high, self.least, self.children, self.members = [], [], [], []
        self.leaves: list[int] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        me = len(self.high)
        p = self.points[rows]
        self.high.append(p.max(0))
        self.least.append(int(self.sizes[rows].min()))
        self.children.append(())
        self.members.append(rows)
        if len(rows) <= LEAF:
            self.leaves.append(me)
            return me
        axis = int((self.high[me] - p.min(0)).argmax())
        order = np.argsort(p[:, axis], kind="stable")
        half = len(rows) // 2
        self.children[me] = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        return me

    def pairs(self, num: int = NUM, den: int = DEN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of all pairs (each once) whose summed coordinate minima reach what a link needs.

        All leaves go down the tree abreast: a step takes each (leaf, node) that the bound leaves to the node's children.
        """
        high, least = np.stack(self.high), np.array(self.least, np.int64)
        children = np.array([c or (-1, -1) for c in self.children])
        place = np.full(len(high), -1)
        place[self.leaves] = np.arange(len(self.leaves))
        leaf = np.array(self.leaves)
        node = np.full(len(leaf), self.root)
        while len(leaf):
            ok = np.zeros(len(leaf), bool)
            for k in range(0, len(leaf), 4096):
                a, b = leaf[k : k + 4096], node[k : k + 4096]
                ok[k : k + 4096] = np.minimum(high[a], high[b]).sum(1, dtype=np.int64) >= needed(least[a], least[b], num, den)
            leaf, node = leaf[ok], node[ok]
            end = place[node] >= 0
            for a, b in zip(leaf[end].tolist(), node[end].tolist(), strict=True):
                if place[a] <= place[b]:
                    i, j = self.members[a], self.members[b]
                    both = np.minimum(self.points[i][:, None, :], self.points[j][None, :, :]).sum(2, dtype=np.int64)
                    x, y = np.nonzero((both >= needed(self.sizes[i][:, None], self.sizes[j][None, :], num, den)) & ((a != b) | (np.arange(len(i))[:, None] < np.arange(len(j))[None, :])))
                    yield i[x], j[y]
            leaf, node = np.repeat(leaf[~end], 2), children[node[~end]].ravel()


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shared values of two sorted arrays of distinct ones."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _link(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    common = _common(x, y)
    return den * common >= num * (len(x) + len(y) - common)


def forest(u: np.ndarray, border: np.ndarray, label: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Row numbers of links that join all components of linked sets, one less than they join.

    Sets lie end to end in u; rows of equal label are joined already. Rows of side 0 are compared with those of side 1
    only, and those of side -1 with each other.
    """
    _, root = np.unique(label, return_inverse=True)
    parent = list(range(int(root.max()) + 1 if len(root) else 0))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = np.diff(border)
    out, left = [], len(parent) - 1
    for i, j in RTree(points(u, border), sizes).pairs(num, den):
        ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] < 0))
        for a, b in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
            x, y = find(int(root[a])), find(int(root[b]))
            if x != y and _link(u[border[a] : border[a + 1]], u[border[b] : border[b + 1]], num, den):
                parent[x] = y
                out.append((a, b))
                left -= 1
        if not left:
            break
    return out


def _leaf_pairs(point: np.ndarray, sizes: np.ndarray, border: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs within each small group (rows border[k] to border[k + 1]) that reach the bound, for all groups abreast."""
    # row i of a group is paired with all rows after it
    after = border[K.owner(border) + 1] - np.arange(len(point)) - 1
    i = np.repeat(np.arange(len(point)), after)
    j = K.ranges(np.arange(len(point)) + 1, after)
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        ok = np.minimum(point[a], point[b]).sum(1, dtype=np.int64) >= needed(sizes[a], sizes[b], num, den)
        yield a[ok], b[ok]


TILE = ("key", "i", "j")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole tiles of a stream that is sorted by tile, with the borders of each."""

    def cut(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return whole, np.append(np.insert(np.flatnonzero(changes(whole)) + 1, 0, 0), whole.num_rows)

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        return np.any([np.diff(np.asarray(batch.column(c)).astype(np.int64)) != 0 for c in TILE], axis=0)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in TILE):
            yield cut(held)
            held = []
        edge = np.flatnonzero(changes(batch))
        if len(edge):
            yield cut([*held, batch[: edge[-1] + 1]])
            held = []
            batch = batch[edge[-1] + 1 :]
        held.append(batch)
    if held:
        yield cut(held)


def _flat(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(batch.column(c)).astype(np.int64) for c in names]


def _candidates(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) within the bound that join the labels of each tile (key, i, j, sig, label, side, n, point): a forest, as in forest()."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, border in _whole(batches):
            sig, label, side, n = _flat(batch, "sig", "label", "side", "n")
            size = np.diff(border)
            tile = K.owner(border)
            # rows of equal label in a tile begin as one
            order = np.lexsort((label, tile))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(label[order]) != 0) | (np.diff(tile[order]) != 0)
            first = np.empty_like(order)
            first[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
            root = first.copy()

            def meet(i: np.ndarray, j: np.ndarray) -> None:
                ok = (side[i] != side[j]) | (side[i] < 0)  # noqa: B023
                i, j = first[i[ok]], first[j[ok]]  # noqa: B023
                while True:
                    x, y = root[i], root[j]  # noqa: B023
                    differ = x != y
                    if not differ.any():
                        return
                    i, j, x, y = i[differ], j[differ], x[differ], y[differ]
                    np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # noqa: B023
                    while True:
                        up = root[root]  # noqa: B023
                        if (up == root).all():  # noqa: B023
                            break
                        root[:] = up  # noqa: B023

            few = np.flatnonzero(size <= LEAF)
            rows = K.ranges(border[few], size[few])
            if len(rows):
                point = unpacked(batch.column("point").take(pa.array(rows)).to_pylist())
                for i, j in _leaf_pairs(point, n[rows], np.concatenate([[0], np.cumsum(size[few])]), num, den):
                    meet(rows[i], rows[j])
            for g in np.flatnonzero(size > LEAF).tolist():
                a, b = int(border[g]), int(border[g + 1])
                for i, j in RTree(unpacked(batch.column("point")[a:b].to_pylist()), n[a:b]).pairs(num, den):
                    meet(a + i, a + j)
            hung = np.flatnonzero((first == np.arange(len(first))) & (root != first))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(sig[hung]), pa.array(sig[root[hung]])], names=["u", "v"])

    return tiles.mapInArrow(K.task(kept), "u long, v long")


def _trees(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) that join the components of each tile's rows (key, i, j, sig, label, side, set)."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, border in _whole(batches):
            sig, label, side = _flat(batch, "sig", "label", "side")
            data, off = K.buffers(batch.column("set"))
            found = []
            for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
                u = np.frombuffer(data[off[a] : off[b]].tobytes(), np.uint64)
                found += [(a + i, a + j) for i, j in forest(u, (off[a : b + 1] - off[a]) // 8, label[a:b], side[a:b], num, den)]
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(sig[j])], names=["u", "v"])

    return tiles.mapInArrow(K.task(joined), "u long, v long")


def _within(pairs: DataFrame, bounds: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of classes whose summed coordinate minima reach what a link needs."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k in range(0, batch.num_rows, 4096):
                part = batch[k : k + 4096]
                a, b = (unpacked(part.column(c).to_pylist()) for c in ("a", "b"))
                n, m = _flat(part, "n", "m")
                ok[k : k + 4096] = np.minimum(a, b).sum(1, dtype=np.int64) >= needed(n, m, num, den)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    first = bounds.select(F.col("sig").alias("u"), "n", F.col("point").alias("a"))
    second = bounds.select(F.col("sig").alias("v"), F.col("n").alias("m"), F.col("point").alias("b"))
    return pairs.join(first, "u").join(second, "v").select("u", "v", "n", "m", "a", "b").mapInArrow(K.task(kept), "u long, v long")


def _verified(pairs: DataFrame, exact: DataFrame, num: int, den: int) -> DataFrame:
    """Stored: the pairs (u, v) of classes that link by their exact sets.

    Goes in as many rounds as it takes for a round's pairs to be small enough to be broadcast: so sets are shuffled only
    where a pair's two meet, at most once each, and a round's shuffles go before the next.
    """

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k in range(0, batch.num_rows, 256):
                flat = []
                for c in ("a", "b"):
                    data, off = K.buffers(batch.column(c)[k : k + 256])
                    flat.append((np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint64), (off - off[0]) // 8))
                (x, xb), (y, yb) = flat
                for r in range(len(xb) - 1):
                    ok[k + r] = _link(x[xb[r] : xb[r + 1]], y[yb[r] : yb[r + 1]], num, den)
            yield batch.select(["u", "v"]).filter(pa.array(ok))

    first = exact.select(F.col("sig").alias("u"), F.col("set").alias("a"))
    rounds, out = max(1, -(-pairs.count() * 24 // max(1, ROUND_BYTES))), None
    for k in range(rounds):
        some = stash(pairs.where(F.pmod(F.xxhash64("v"), F.lit(rounds)) == k), "pairs") if rounds > 1 else pairs
        n = some.count()
        second = exact.join(small(some.select(F.col("v").alias("sig")).distinct(), n, 16), "sig", "left_semi").select(F.col("sig").alias("v"), F.col("set").alias("b"))
        found = stash(first.join(small(some, n, 24), "u").join(second, "v").select("u", "v", "a", "b").mapInArrow(K.task(linked), "u long, v long"), "links")
        out = found if out is None else out.unionByName(found)
        if rounds > 1:
            drop_stash(some)
        release_shuffles(pairs.sparkSession)
    return out


def _chosen(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Stored: one text (doc_id, th) of each class (sig), and the times that docs has it."""
    one = sets.where("n > 0").join(classes, "sig", "left_semi").groupBy("sig", "doc_id", "th").agg(F.count("*").alias("times"))
    return stash(one.groupBy("sig").agg(F.min(F.struct("doc_id", "th", "times")).alias("r")).select("sig", "r.*"), "chosen")


def _read(docs: DataFrame, chosen: DataFrame, size: int, exact: bool) -> DataFrame:
    """Stored, from the chosen texts: sig, n and point of each class, or if exact its sig and set (sorted hashes)."""
    row = small(chosen, chosen.count(), 48)
    plain = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    texts = plain.join(row, plain["doc_id"].eqNullSafe(row["doc_id"]) & (plain["th"] == row["th"])).select("sig", "times", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off):
                found = shingles(*K.cut(data, off, a, b), size)
                ids = [batch.column("sig")[a:b], batch.column("times")[a:b]]
                if exact:
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([x.tobytes() for x in found], pa.binary())], names=["sig", "times", "set"])
                else:
                    point = pa.array([packed(points(x, np.array([0, len(x)]))[0]) for x in found], pa.binary())
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([len(x) for x in found], pa.int64()), point], names=["sig", "times", "n", "point"])

    known = stash(texts.mapInArrow(K.task(made), "sig long, times long, " + ("set binary" if exact else "n long, point binary")), "sets-of-classes" if exact else "points")
    # only a row that is repeated in docs gives its class more than once
    again = known.where("times > 1")
    if not again.isEmpty():
        known = known.where("times = 1").unionByName(again.dropDuplicates(["sig"]))
    return known.drop("times")


def _exact(docs: DataFrame, chosen: DataFrame, sigs: DataFrame, size: int) -> DataFrame:
    """Stored: sig and set of some classes only, as sets are larger than their texts."""
    some = stash(chosen.join(sigs, "sig", "left_semi"), "chosen")
    found = _read(docs, some, size, True)
    drop_stash(some)
    return found


def _mixed(labelled: DataFrame) -> DataFrame:
    """The rows (key, sig, label) of keys that hold several labels."""
    several = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    return labelled.join(several, "key")


def _tiles(rows: DataFrame, bounds: DataFrame, known: DataFrame, *columns: str) -> DataFrame:
    """Rows (key, sig, label) dealt to tiles (key, i, j), with the side in the tile and columns of the class as known; sorted by tile.

    Beyond CHUNK shingles (of at least GROUPS each row) a key is cut into parts, and each pair of those is a tile.
    """
    left = stash(rows.join(bounds.select("sig", "n"), "sig"), "mixed")
    parts = left.groupBy("key").agg(F.ceil(F.sum(F.greatest(F.col("n"), F.lit(GROUPS))) / CHUNK).cast("int").alias("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = left.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("sig", "key"), F.col("parts")).cast("int")).select("key", "sig", "label", "part", other)
    side = F.when(F.col("part") == F.col("other"), F.lit(-1)).otherwise((F.col("part") > F.col("other")).cast("int"))
    tiles = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "sig", "label", side.alias("side"))
    return tiles.join(known.select("sig", *columns), "sig").repartition(*TILE).sortWithinPartitions(*TILE)


def link(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The stored sets of all rows, and (node, label) of every class that links with a different one."""
    spark = docs.sparkSession
    found = _sets(docs, num, den, size)
    release_shuffles(spark)
    sets = found.where("key is null").drop("key")
    raw = stash(found.where("key is not null").select("key", "sig").distinct(), "cells")
    per_cell = raw.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.col("sig").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("sig")).alias("x"))
    popular = raw.groupBy("sig").agg(F.count("*").alias("cells"))
    # cells of the same classes are one
    kept = per_cell.groupBy("size", "s", "x").agg(F.min("key").alias("key")).select("key")
    members = stash(raw.join(kept, "key").join(popular, "sig").select("key", "sig", "cells"), "members")
    chosen = _chosen(sets, members.select("sig").distinct())
    drop_stash(raw)
    release_shuffles(spark)
    bounds = _read(docs, chosen, size, False)
    release_shuffles(spark)

    hubs = members.groupBy("key").agg(F.max(F.struct("cells", "sig")).alias("hub"))
    stars = members.join(hubs, "key").where("sig <> hub.sig").groupBy("sig").agg(F.max("hub").alias("hub"))
    # only pairs within the bound need their sets
    stars = stash(_within(stars.select(F.col("sig").alias("u"), F.col("hub.sig").alias("v")), bounds, num, den), "stars")
    release_shuffles(spark)
    exact = _exact(docs, chosen, stars.select(F.col("u").alias("sig")).union(stars.select("v")).distinct(), size)
    release_shuffles(spark)
    first = _verified(stars, exact, num, den)
    drop_stash(exact)
    drop_stash(stars)
    label = stash(components(first), "labels")
    release_shuffles(spark)

    labelled = members.join(label, F.col("sig") == F.col("node"), "left").select("key", "sig", F.coalesce("label", "sig").alias("label"))
    near = stash(_candidates(_tiles(_mixed(labelled), bounds, bounds, "n", "point"), num, den).distinct(), "near")
    drop_stash(members)
    release_shuffles(spark)
    # sets come once to the component of links and candidates, and only where it still holds several labels
    around = components(first.unionByName(near))
    labelled = around.select(F.col("label").alias("key"), F.col("node").alias("sig")).join(label, F.col("sig") == F.col("node"), "left").select("key", "sig", F.coalesce("label", "sig").alias("label"))
    several = stash(_mixed(labelled), "several")
    release_shuffles(spark)
    exact = _exact(docs, chosen, several.select("sig").distinct(), size)
    release_shuffles(spark)
    second = stash(_trees(_tiles(several, bounds, exact, "set"), num, den), "links")
    drop_stash(exact)
    release_shuffles(spark)
    every = components(first.unionByName(second))
    release_shuffles(spark)
    for gone in (chosen, bounds, label, first, near, several, second):
        drop_stash(gone)
    return sets, stash(every, "components")


def join(docs: DataFrame, num: int = NUM, den: int = DEN, size: int = WORDS) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id and label (the component's least class; null without shingles) of each row of docs (doc_id, text)."""
    sets, label = link(docs.select("doc_id", "text"), num, den, size)
    named = sets.select("doc_id", "th", "n", "sig").join(label, F.col("sig") == F.col("node"), "left")
    named = named.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.coalesce("label", "sig")).alias("label"))
    least = named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1").select("label", "least")
    return named.join(least, "label", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "label")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop("th", "label")


QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
SQL = {
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reached),
m AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id"""
}
