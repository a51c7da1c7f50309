"""Vectorised work on the byte buffers of Arrow string columns: words, hashes and runs, without Python strings."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once, so that temporaries stay in the cache.
SLICE = 1 << 19

SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[0x20, *range(0x09, 0x0E)]] = True
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[0x41:0x5B] += 32


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about limit bytes; a longer document comes alone."""
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def cut(data: np.ndarray, off: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents a to b: their bytes, and offsets from 0."""
    return data[off[a] : off[b]], off[a : b + 1] - off[a]


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document borders."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return starts, ends


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each document its first word (n + 1 borders)."""
    starts, ends = runs(~space[data], off)
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the eight bytes from there as a little-endian number; the end is padded with zeros."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded.data, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step; the length counts too."""
    at = eights(data) if at is None else at
    size = ends - starts
    h = mix((size.astype(U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))
    live, pos, left = None, starts, size
    while len(pos):
        block = at[pos] & _MASK[np.minimum(left, 8)]
        if live is None:
            h = mix((h ^ block) + U64(0x632BE59BD9B4E019))
        else:
            h[live] = mix((h[live] ^ block) + U64(0x632BE59BD9B4E019))
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        pos, left = pos[more] + 8, left[more] - 8
    return h


def order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit numbers, as unsigned ones, and the numbers in it.

    Their first bits are sorted with their places in the last ones, as a sort of values is several times faster than one of
    places; where different numbers have equal first bits, they are sorted once more.
    """
    keys = keys.view(U64)
    if len(keys) < 2:
        return np.arange(len(keys)), keys
    bits = (len(keys) - 1).bit_length()
    low = U64((1 << bits) - 1)
    packed = (keys & ~low) | np.arange(len(keys), dtype=U64)
    packed.sort()
    places = (packed & low).view(np.int64)
    out = keys[places]
    wrong = np.flatnonzero(out[1:] < out[:-1])
    if len(wrong) > 1000:
        places = np.argsort(keys, kind="stable")
        return places, keys[places]
    first = packed >> U64(bits)
    for head in np.unique(first[wrong]):
        a, b = np.searchsorted(first, head), np.searchsorted(first, head, "right")
        places[a:b] = places[a:b][np.argsort(out[a:b], kind="stable")]
        out[a:b] = keys[places[a:b]]
    return places, out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of 64-bit numbers, sorted as unsigned ones, and which of them each number is."""
    places, keys = order(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    which = np.empty(len(keys), np.int64)
    which[places] = np.cumsum(new) - 1
    return keys[new], which


def owner(border: np.ndarray) -> np.ndarray:
    """The document of each element, from borders."""
    return np.repeat(np.arange(len(border) - 1), np.diff(border))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for sizes[0] elements, then the next."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def lists(values: np.ndarray, border: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(border.astype(np.int32), pa.int32()), pa.array(values, kind))


def release() -> None:
    """Gives freed memory back to the system, as a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def task(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, with its memory given back when the task ends."""

    def done(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release()

    return done
