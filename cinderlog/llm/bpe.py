"""Byte-level BPE by corpus-level merge replay.

A task cuts a block of whole texts into pattern matches, keeps each distinct match once, and replays the merges over
all of them together: an inverted index leads from a pair's rank to its places in all words, ranks are taken in order,
all places of a rank are merged at once, and only the pairs on both sides of a merge are looked up again and entered
anew. A document's ids are then its matches' ids, one after another. Nothing is shuffled; a block is about BLOCK bytes
of text, so memory doesn't grow with the corpus, and a block lost with its executor is simply done again.

Words are independent, and a word's own lowest rank is always met before its higher ones (a new pair of a lower rank
than the current goes to the head of the queue), so the ids are those of merging each word by itself. Where a vocabulary
lets a merge make a pair of a lower rank, a word gives one place a turn; words beyond WORD bytes, which would take many
turns, have an index of their own: a heap of (rank, place), in n log n steps for any length.

Defined cases: a null or empty text has no ids; texts and matches of any length are whole; repeated rows get equal
results; of places of equal rank the leftmost goes first; a null doc_id is kept; an empty table gives no rows; other
columns are kept by encode() and not read by the query.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cinderlog.llm import kernels as K
from cinderlog.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose words are replayed together.
BLOCK = 8 << 20
#: Characters from which a text is cut match by match, without a list of all its matches.
LONG = 4 << 20
#: Bytes of a word beyond which it is merged by a heap of its own.
WORD = 512
NONE = np.int32(2**31 - 1)


@dataclass(frozen=True)
class Ranks:
    """pairs: sorted keys (left id << 32 | right id) and merged ids; token bytes end to end with borders."""

    single: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    data: np.ndarray
    border: np.ndarray
    #: Whether no merge makes a pair of a lower rank than its own.
    ordered: bool

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Ranks:
        keys, merged = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        pair_keys, pair_ranks = np.array(keys, np.int64)[order], np.array(merged, np.int32)[order]
        single = np.full(256, -1, np.int32)
        for b in range(256):
            single[b] = ranks.get(bytes([b]), -1)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        made = {r for t, r in ranks.items() if len(t) > 1}
        inner = np.array([k >> 32 if (k >> 32) in made else -1 for k in keys], np.int64)
        inner = np.maximum(inner, np.array([k & 0xFFFFFFFF if (k & 0xFFFFFFFF) in made else -1 for k in keys], np.int64)) if keys else inner
        return cls(
            single, pair_keys, pair_ranks, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])]),
            bool((inner < np.array(merged, np.int64)).all()) if keys else True,
        )

    def one(self, left: int, right: int) -> int | None:
        """The merged id of one pair, by bisection of what all pairs share: a table of its own would stay with every worker."""
        key = left << 32 | right
        at = bisect.bisect_left(self.pair_keys, key)
        return int(self.pair_ranks[at]) if at < len(self.pair_keys) and self.pair_keys[at] == key else None

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NONE where there is no merge."""
        if not len(self.pair_keys):
            return np.full(len(left), NONE)
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)


def _merged(ranks: Ranks, word: bytes) -> list[int]:
    """Ids of one word: places wait in a heap by rank, the leftmost first, and only touched neighbours enter anew."""
    single = ranks.single[np.frombuffer(word, np.uint8)]
    if len(single) and single.min() < 0:
        raise ValueError("a byte has no rank of its own")
    symbol, n = single.tolist(), len(single)
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    rank = [None if r == NONE else r for r in ranks.rank(single[:-1], single[1:]).tolist()] + [None]
    queue = [r << 32 | i for i, r in enumerate(rank) if r is not None]
    heapq.heapify(queue)
    while queue:
        top = heapq.heappop(queue)
        r, i = top >> 32, top & 0xFFFFFFFF
        if rank[i] != r:
            continue
        j = after[i]
        symbol[i], symbol[j], rank[j] = r, -1, None
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a in (before[i], i):
            if a < 0:
                continue
            b = after[a]
            rank[a] = x = ranks.one(symbol[a], symbol[b]) if b >= 0 else None
            if x is not None:
                heapq.heappush(queue, x << 32 | a)
    return [x for x in symbol if x >= 0]


def replay(ranks: Ranks, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and each word's border, by one replay of the merges over all words."""
    long = [k for k, w in enumerate(words) if len(w) > WORD] if not ranks.ordered else []
    if long:
        own = {k: np.array(_merged(ranks, words[k]), np.int32) for k in long}
        ids, border = replay(ranks, [b"" if k in own else w for k, w in enumerate(words)])
        parts = np.split(ids, border[1:-1])
        parts = [own.get(k, x) for k, x in enumerate(parts)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    size = np.fromiter(map(len, words), np.int64, len(words))
    border = np.concatenate([[0], np.cumsum(size)])
    n = int(border[-1])
    symbol = ranks.single[np.frombuffer(b"".join(words), np.uint8)]
    if n and symbol.min() < 0:
        raise ValueError("a byte has no rank of its own")
    after = np.arange(1, n + 1, dtype=np.int32)
    before = np.arange(-1, n - 1, dtype=np.int32)
    after[border[1:][size > 0] - 1] = -1
    before[border[:-1][size > 0]] = -1
    # the index: rank -> places; first the pairs of bytes, sorted once
    rank = np.full(n + 1, NONE, np.int32)  # the last stands for "no neighbour"
    inner = np.flatnonzero(after >= 0)
    rank[inner] = ranks.rank(symbol[inner], symbol[inner + 1])
    inner = inner[rank[inner] != NONE]
    inner = inner[np.argsort(rank[inner], kind="stable")].astype(np.int32)
    values, at = np.unique(rank[inner], return_index=True)
    ends = np.append(at[1:], len(inner))[: len(at)]
    index: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    for v, a, b in zip(values.tolist(), at.tolist(), ends.tolist(), strict=True):
        index[v].append(inner[a:b])
    queue = values.tolist()
    word = None if ranks.ordered else K.owner(border)
    while queue:
        r = heapq.heappop(queue)
        parts = index.pop(r)
        places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        places = places[rank[places] == r]
        if not len(places):
            continue
        right = after[places]
        if len(places) > 1:
            if word is not None:
                # a merge may make a pair that comes first: one merge a word, the others wait
                first = np.ones(len(places), bool)
                first[1:] = word[places[1:]] != word[places[:-1]]
                if not first.all():
                    index[r].append(places[~first])
                    heapq.heappush(queue, r)
                    places, right = places[first], right[first]
            else:
                # in a chain of overlapping pairs every second one from the left merges
                linked = np.zeros(len(places), bool)
                linked[1:] = right[:-1] == places[1:]
                if linked.any():
                    start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(places))))
                    even = (np.arange(len(places)) - start) % 2 == 0
                    places, right = places[even], right[even]
        beyond = after[right]
        symbol[places] = r
        after[places] = beyond
        has = beyond >= 0
        before[beyond[has]] = places[has]
        rank[right] = NONE
        symbol[right] = -1
        # the touched neighbours: the pair that starts at each merged place, and the one that ends there
        left = before[places]
        left = left[left >= 0]
        touched = np.concatenate([places[has], left])
        rank[places] = NONE
        if not len(touched):
            continue
        fresh = ranks.rank(symbol[touched], symbol[after[touched]])
        rank[touched] = fresh
        touched, fresh = touched[fresh != NONE], fresh[fresh != NONE]
        if not len(touched):
            continue
        if len(touched) > 1:
            order = np.argsort(fresh, kind="stable")
            touched, fresh = touched[order], fresh[order]
            cut = np.flatnonzero(fresh[1:] != fresh[:-1]) + 1
            bounds = [0, *cut.tolist(), len(fresh)]
        else:
            bounds = [0, 1]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            v = int(fresh[a])
            if v not in index:
                heapq.heappush(queue, v)
            index[v].append(touched[a:b])
    left_over = symbol >= 0
    counts = np.concatenate([[0], np.cumsum(left_over)])
    return symbol[left_over], counts[border]


def encode_block(ranks: Ranks, pattern: regex.Pattern, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and each text's border."""
    number: defaultdict[str, int] = defaultdict()
    number.default_factory = number.__len__
    cut = []
    for text in texts:
        if not text:
            cut.append(np.zeros(0, np.int32))
        elif len(text) < LONG:
            found = pattern.findall(text)
            cut.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
        else:
            cut.append(np.fromiter((number[m.group()] for m in pattern.finditer(text)), np.int32))
    words = [w.encode() for w in number]
    number.clear()
    ids, border = replay(ranks, words)
    size = np.diff(border)
    out, ends = [], [0]
    for which in cut:
        out.append(ids[K.ranges(border[which], size[which])])
        ends.append(ends[-1] + len(out[-1]))
    return np.concatenate(out) if out else ids[:0], np.array(ends)


def decode(ranks: Ranks, ids: np.ndarray) -> bytes:
    """The bytes of the ids' tokens."""
    return ranks.data[K.ranges(ranks.border[ids], ranks.border[ids + 1] - ranks.border[ids])].tobytes()


def _spread(docs: DataFrame, ranks: Ranks, pattern: str, keep: list[str], schema: str, made) -> DataFrame:
    """Runs made(ranks, ids, border) over blocks of texts beside the kept columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            _, off = K.buffers(batch.column("text"))
            for a, b in K.slices(off, BLOCK):
                ids, border = encode_block(shared.value, compiled, batch.column("text")[a:b].to_pylist())
                columns, names = made(shared.value, ids, border)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), *columns], names=[*keep, *names])
                del ids, border, columns
                K.release()

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, docs["text"]).mapInArrow(K.task(encoded), ", ".join([*kept, schema]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs but the text, with the text's ids as an array."""
    keep = [c for c in docs.columns if c != "text"]
    return _spread(docs, Ranks.read(path), pattern, keep, "ids array<int>", lambda _, ids, border: ([K.lists(ids, border, pa.int32())], ["ids"]))


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded but the ids, with the decoded bytes; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(Ranks.read(path))
    keep = [c for c in encoded.columns if c != "ids"]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(shared.value, np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], names=[*keep, "decoded"])

    kept = [f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in keep]
    return encoded.select(*keep, "ids").mapInArrow(K.task(decoded), ", ".join([*kept, "decoded binary"]))


def _digests(ranks: Ranks, ids: np.ndarray, border: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    little = ids.astype("<u4")
    of_ids, of_text = [], []
    for a, b in zip(border[:-1].tolist(), border[1:].tolist(), strict=True):
        of_ids.append(hashlib.sha256(little[a:b].tobytes()).hexdigest())
        of_text.append(hashlib.sha256(decode(ranks, ids[a:b])).hexdigest())
    return [pa.array(np.diff(border).astype(np.int64)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"]


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the bytes they decode to."""
    return _spread(docs.select("doc_id", "text"), Ranks.read(path), pattern, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
