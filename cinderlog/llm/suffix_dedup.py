"""Removal of repeated byte strings by suffix arrays.

Each byte goes that is covered by a string of LENGTH bytes which also starts earlier: in a smaller doc_id, or earlier in
the same document. Strings are judged on the input.

1. Later copies of whole texts are found by a digest; only the first copy goes on.
2. Every window of LENGTH bytes has a lead gram: that of least hash among its grams, the leftmost of equals. Equal
   windows have equal lead grams, so a window whose lead gram occurs once in the corpus has no copy. Windows in a row with
   one lead gram are a snippet; lead grams are counted over the corpus and only snippets with a repeated one go on.
3. Snippets are dealt to shards by lead gram, so that all copies of a window meet. A shard settles equal snippets
   first, and sorts the suffixes of the others: ranks of eight bytes, then Larsson-Sadakane refinement by doubling, in
   which only groups that are still unsorted are sorted again; Kasai's common prefixes, carried along all snippets at
   once, tell which neighbouring suffixes agree in LENGTH bytes. The least place of each such group stays.
4. A lead gram of more than CAP snippets is split over several shards. Their first windows are merged by ranges of the
   suffix order: a shard's sorted windows are looked up in those of the others by binary search.
5. Removed runs are merged by document and cut out of the texts.

Defined cases: a null text is empty; texts below LENGTH bytes have nothing to remove; rows of equal doc_id but different
texts are different documents of which neither comes first; repeated rows are one document; a null doc_id comes after
all others; of equal strings in one text the earliest stays; texts of any length are whole; an empty table gives no
rows; other columns are not read; a doc_id that isn't a whole number counts by its order among all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.llm import kernels as K
from cinderlog.llm.common import drop_stash, small, stash, table, text_hash, utf8_bytes

LENGTH, GRAM = 100, 32
#: Snippets of one lead gram in a shard, and bytes of snippets that are sorted at once.
CAP, SHARD = 4096, 1 << 20
#: Bits of a byte's place beside a gram's hash; longer texts are gone through in pieces of so many bytes.
PLACE = 28
LAST = 2**63 - 1
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _leads(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """By byte, the place of the lead gram of the window that starts there, and the hash of the gram that does; at most 2 ** PLACE bytes."""
    n = len(data)
    width = length - gram + 1
    at = K.eights(np.concatenate([data, np.zeros(gram, np.uint8)]))
    h = at[:n] * _ODD[0]
    for k in range(8, gram, 8):
        step = min(k, gram - 8)
        h += (at[step : n + step] ^ (h >> np.uint64(29))) * _ODD[(k // 8) % 4]
    h = K.mix(h)
    low = np.uint64((1 << PLACE) - 1)
    key = (h & ~low) | np.arange(n, dtype=np.uint64)
    # sliding minimum by doubling
    best, have = key, 1
    while have * 2 <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    return (best & low).astype(np.int64), h


def snippets(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and lead gram's hash of each snippet, and the documents' borders."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty.astype(np.uint64), np.zeros(len(off), np.int64)
    if n <= 1 << PLACE:
        lead, h = _leads(data, length, gram)
    else:
        # pieces that overlap by a window, so that each window lies in one
        step = (1 << PLACE) - length
        parts = [(c, *_leads(data[c : c + step + length - 1], length, gram)) for c in range(0, n - length + 1, step)]
        lead = np.concatenate([c + x[:step] for c, x, _ in parts])
        h = np.concatenate([*(x[:step] for _, _, x in parts[:-1]), parts[-1][2]])
    sizes = np.maximum(np.diff(off) - length + 1, 0)
    starts = K.ranges(off[:-1], sizes)
    if not len(starts):
        return empty, empty, empty.astype(np.uint64), np.zeros(len(off), np.int64)
    lead = lead[starts]
    new = np.ones(len(starts), bool)
    new[1:] = lead[1:] != lead[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    doc_border = np.searchsorted(first, np.concatenate([[0], np.cumsum(sizes)]))
    return starts[first], starts[last], h[lead[first]], doc_border


def suffix_array(text: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The order of all suffixes, each up to its end, none longer than depth; one that ends comes first, equals by place.

    Larsson-Sadakane: ranks are those of groups; a round doubles the compared length and sorts only groups of several.
    """
    n = len(text)
    left = end - np.arange(n)
    at = K.eights(text)[:n]
    block = (at & K._MASK[np.minimum(left, 8)]).byteswap()
    order = np.lexsort((np.minimum(left, 8), block))
    same = np.zeros(n, bool)
    same[1:] = (block[order[1:]] == block[order[:-1]]) & (np.minimum(left[order[1:]], 8) == np.minimum(left[order[:-1]], 8))
    rank = np.zeros(n + 1, np.int64)  # the last is the empty suffix
    heads = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    rank[order] = heads + 1
    h = 8
    while h < depth:
        grouped = same.copy()
        grouped[:-1] |= same[1:]
        open_ = np.flatnonzero(grouped)
        if not len(open_):
            break
        rows = order[open_]
        beyond = np.where(rows + h < end[rows], rows + h, n)
        a, b = rank[rows], rank[beyond]
        by = np.argsort((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), kind="stable")
        rows, a, b = rows[by], a[by], b[by]
        order[open_] = rows
        tied = np.zeros(len(rows), bool)
        tied[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        same[open_] = tied
        rank[rows] = open_[np.maximum.accumulate(np.where(tied, 0, np.arange(len(rows))))] + 1
        h *= 2
    return order


def common_prefixes(text: np.ndarray, start: np.ndarray, end: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix in order, the length it has in common with the one before, up to most.

    Kasai: the suffix one byte on shares at least one byte less with its own predecessor; all snippets (start, end)
    are gone through abreast, so a step works on one suffix of each.
    """
    n = len(text)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    limit = np.repeat(end.astype(np.int32), end - start)
    at = K.eights(text)
    out = np.zeros(n, np.int32)
    live = np.argsort(start - end, kind="stable")  # longest first
    size = (end - start)[live]
    have = np.zeros(len(live), np.int64)
    for j in range(int(size[0]) if len(size) else 0):
        k = int(np.searchsorted(-size, -j, "left"))
        i = start[live[:k]] + j
        p = before[i]
        shared = np.maximum(have[:k] - 1, 0)
        shared[p < 0] = 0
        todo = np.flatnonzero((p >= 0) & (shared < most))
        while len(todo):
            x, y = i[todo] + shared[todo], p[todo] + shared[todo]
            room = np.minimum(np.minimum(limit[i[todo]] - x, limit[p[todo]] - y), 8)
            differ = at[x] ^ at[y]
            bits = differ & (~differ + np.uint64(1))
            equal = np.where(differ == 0, 8, np.log2(np.maximum(bits, np.uint64(1)).astype(float)).astype(np.int64) >> 3)
            step = np.minimum(equal, room)
            shared[todo] += step
            todo = todo[(step == 8) & (shared[todo] < most)]
        have[:k] = shared
        out[place[i]] = np.minimum(shared, most)
    return out


def window_groups(text: np.ndarray, start: np.ndarray, end: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all snippets in suffix order: their places, their snippets and the numbers of their groups of equals."""
    limit = np.repeat(end.astype(np.int32), end - start)
    owner = np.repeat(np.arange(len(start), dtype=np.int32), end - start)
    order = suffix_array(text, limit, int((end - start).max()))
    shared = common_prefixes(text, start, end, order, length)
    whole = np.flatnonzero(limit[order] - order >= length)
    new = np.ones(len(whole), bool)
    if len(whole) > 1:
        # two windows share what all neighbours between them share
        new[1:] = np.minimum.reduceat(shared[: whole[-1] + 1], whole[:-1] + 1) < length
    return order[whole], owner[order[whole]], np.cumsum(new) - 1


def _runs(rid: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the windows (rid, start), neighbours merged."""
    if not len(rid):
        return rid, start, start
    order = np.lexsort((start, rid))
    rid, start = rid[order], start[order]
    new = np.ones(len(rid), bool)
    new[1:] = (rid[1:] != rid[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return rid[first], start[first], start[last] + length


Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]


def resolve(rows: Rows, length: int = LENGTH, keep: bool = False) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], list[tuple]]:
    """Removed spans (rid, start, end) of a shard's snippets (gram, rid, doc, start, bytes); with keep, its first windows too."""
    gram, rid, doc, start, blobs = rows
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(b, len(number)) for b in blobs), np.int64, len(blobs))
    unique = list(number)
    size = np.fromiter(map(len, unique), np.int64, len(unique))
    least = np.full(len(unique), LAST)
    np.minimum.at(least, which, doc)
    later = doc > least[which]
    spans = [(rid[later], start[later], start[later] + size[which[later]])]
    gram_of = np.zeros(len(unique), gram.dtype)
    gram_of[which] = gram
    _, group, count = np.unique(gram_of, return_inverse=True, return_counts=True)
    pick = np.flatnonzero((count[group] > 1) | keep)
    if not len(pick):
        return spans, []
    text = np.frombuffer(b"".join(unique[k] for k in pick), np.uint8)
    end = np.cumsum(size[pick])
    begin = end - size[pick]
    place, snippet, equal = window_groups(text, begin, end, length)
    first = np.full(int(equal[-1]) + 1 if len(equal) else 0, LAST)
    np.minimum.at(first, equal, least[pick[snippet]])
    # rows that are first among equal snippets, by snippet
    stays = np.flatnonzero(~later)
    stays = stays[np.argsort(which[stays], kind="stable")]
    border = np.searchsorted(which[stays], np.arange(len(unique) + 1))
    of = pick[snippet]
    many = border[of + 1] - border[of]
    row = stays[K.ranges(border[of], many)]
    at = np.repeat(place - begin[snippet], many) + start[row]
    equal, place = np.repeat(equal, many), np.repeat(place, many)
    gone = doc[row] > first[equal]
    # the same window again in one document
    order = np.lexsort((at, rid[row], equal))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (equal[order[1:]] == equal[order[:-1]]) & (rid[row[order[1:]]] == rid[row[order[:-1]]]) & (at[order[1:]] > at[order[:-1]])
    gone |= again
    spans.append(_runs(rid[row[gone]], at[gone], length))
    if not keep:
        return spans, []
    left = ~gone
    return spans, [(text[p : p + length].tobytes(), int(doc[r]), int(rid[r]), int(a)) for p, r, a in zip(place[left], row[left], at[left], strict=True)]


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of shards (sorted windows, docs) once, sorted, with their least doc; each shard is looked up by binary search."""
    known, least = shards[0]
    for windows, docs in shards[1:]:
        at = np.searchsorted(known, windows)
        inside = np.minimum(at, len(known) - 1)
        hit = known[inside] == windows
        np.minimum.at(least, inside[hit], docs[hit])
        known = np.insert(known, at[~hit], windows[~hit])
        least = np.insert(least, at[~hit], docs[~hit])
    return known, least


def _snippet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Snippets with a repeated lead gram; one that occurred before in its document is a span at once (no bytes)."""
    for batch in batches:
        data, off = K.buffers(batch.column("text"))
        rid, doc = batch.column("rid").to_pylist(), batch.column("doc").to_pylist()
        grams, salts = batch.column("grams").to_pylist(), batch.column("salts").to_pylist()
        for a, b in K.slices(off):
            part, border = K.cut(data, off, a, b)
            first, last, gram, docs = snippets(part, border)
            first, last, gram = first.tolist(), last.tolist(), gram.view(np.int64).tolist()
            blob = part.tobytes()
            out: list[list] = [[], [], [], [], [], [], []]
            for d in range(a, b):
                seen: set[bytes] = set()
                wanted = dict(zip(grams[d], salts[d], strict=True))
                for i in range(int(docs[d - a]), int(docs[d - a + 1])):
                    if gram[i] not in wanted:
                        continue
                    cut = blob[first[i] : last[i] + LENGTH]
                    row = (gram[i], rid[d], doc[d], first[i] - int(border[d - a]), len(cut), wanted[gram[i]], None if cut in seen else cut)
                    seen.add(cut)
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:6]), pa.array(out[6], pa.binary())], names=["gram", "rid", "doc", "start", "size", "salts", "snippet"])


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted snippets in, spans and the first windows of split lead grams out; a shard ends where the gram changes."""
    held: list[pa.RecordBatch] = []
    size = 0

    def settle(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, salt, of = (np.asarray(batch[c].combine_chunks()) for c in ("gram", "salt", "salts"))
        split = of > 1
        for keep in (False, True):
            rows = np.flatnonzero(split == keep)
            if not len(rows):
                continue
            part = batch.take(pa.array(rows))
            numbers = [np.asarray(part[c].combine_chunks()) for c in ("gram", "rid", "doc", "start")]
            spans, windows = resolve((*numbers, part["snippet"].to_pylist()), LENGTH, keep)
            for r, s, e in spans:
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(e), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.binary())], names=_SPANS)
            if windows:
                w, d, r, a = zip(*windows, strict=True)
                a = np.array(a, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(a), pa.array(a + LENGTH), pa.array(d, pa.int64()), pa.array(np.full(len(a), int(salt[rows[0]]))), pa.array(w, pa.binary())], names=_SPANS)

    def shards(all_: list[pa.RecordBatch], end: bool) -> tuple[list[pa.Table], list[pa.RecordBatch]]:
        whole = pa.Table.from_batches(all_)
        gram, salt = np.asarray(whole["gram"].combine_chunks()), np.asarray(whole["salt"].combine_chunks())
        new = np.flatnonzero((gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])) + 1
        cut = len(whole) if end else int(new[-1]) if len(new) else 0
        # a salted shard stands alone: its windows must be merged with those of the same gram elsewhere
        of = np.asarray(whole["salts"].combine_chunks())
        bounds = sorted({0, cut, *(int(x) for x in new if x <= cut and (of[x] > 1 or of[x - 1] > 1))})
        return [whole.slice(x, y - x) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], whole.slice(cut).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        for k in range(0, batch.num_rows, 4096):
            piece = batch.slice(k, 4096)
            held.append(piece)
            size += int(np.asarray(piece.column("size")).sum())
            if size >= SHARD:
                ready, held = shards(held, False)
                size = sum(int(np.asarray(x.column("size")).sum()) for x in held)
                for shard in ready:
                    yield from settle(shard)
    if held:
        for shard in shards(held, True)[0]:
            yield from settle(shard)


_SPANS = ["rid", "start", "end", "doc", "salt", "window"]


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of the suffix order: windows of split lead grams that have a smaller doc in another shard."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    whole = pa.Table.from_batches(parts)
    rid, start, doc, salt = (np.asarray(whole[c].combine_chunks()) for c in ("rid", "start", "doc", "salt"))
    window = np.frombuffer(b"".join(whole["window"].to_pylist()), f"V{LENGTH}").view(f"S{LENGTH}")
    shards = []
    for s in np.unique(salt):
        mine = np.flatnonzero(salt == s)
        w, at = np.unique(window[mine], return_inverse=True)
        least = np.full(len(w), LAST)
        np.minimum.at(least, at, doc[mine])
        shards.append((w, least))
    known, least = merge_shards(shards)
    gone = doc > least[np.searchsorted(known, window)]
    r, s, e = _runs(rid[gone], start[gone], LENGTH)
    yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(s), pa.array(e)], names=["rid", "start", "end"])


def _lead_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different lead grams of each document, with how often they lead a snippet."""
    for batch in batches:
        data, off = K.buffers(batch.column("text"))
        for a, b in K.slices(off):
            _, _, gram, docs = snippets(*K.cut(data, off, a, b))
            found = [np.unique(gram[x:y], return_counts=True) for x, y in zip(docs[:-1].tolist(), docs[1:].tolist(), strict=True)]
            border = np.concatenate([[0], np.cumsum([len(g) for g, _ in found])])
            grams = K.lists(np.concatenate([g for g, _ in found]).view(np.int64), border, pa.int64())
            counts = K.lists(np.concatenate([c for _, c in found]), border, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in ("doc_id", "th", "rid", "n", "digest")), grams, counts], names=["doc_id", "th", "rid", "n", "digest", "grams", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans in order and apart."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = []
        for spans in batch.column("spans").to_pylist():
            apart: list[dict] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if apart and s["start"] <= apart[-1]["end"]:
                    apart[-1]["end"] = max(apart[-1]["end"], s["end"])
                else:
                    apart.append(s)
            out.append(apart)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, kind)], names=["rid", "spans"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = K.buffers(batch.column("text"))
        n, gone, count, left = [], [], [], []
        for a, b, cut in zip(off[:-1].tolist(), off[1:].tolist(), batch.column("spans").to_pylist(), strict=True):
            blob, at, kept, out = data[a:b].tobytes(), 0, [], 0
            for s in cut or ():
                kept.append(blob[at : s["start"]])
                at = s["end"]
                out += s["end"] - s["start"]
            left.append(b"".join([*kept, blob[at:]]))
            n.append(b - a)
            gone.append(out)
            count.append(len(cut or ()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(left, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """Stored: (doc_id, th, spans) of documents (doc_id, text) with something to remove; spans are apart and in order."""
    text = F.col("text")
    known = docs.select("doc_id", text_hash(text).alias("th"), F.monotonically_increasing_id().alias("rid"), utf8_bytes(text).alias("n"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("digest"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    grams = stash(known.mapInArrow(K.task(_lead_grams), f"doc_id {kind}, th long, rid long, n long, digest string, grams array<long>, counts array<long>"), "lead-grams")
    made = [grams]
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        ids = grams.withColumn("doc", F.col("doc_id").cast("long"))
    else:
        order = stash(docs.select("doc_id").where("doc_id is not null").distinct().orderBy("doc_id").select("doc_id", F.monotonically_increasing_id().alias("doc")), "order")
        made.append(order)
        ids = grams.join(order, "doc_id", "left")
    ids = ids.where(F.col("n") >= LENGTH).select("rid", "doc_id", "th", "n", "digest", F.coalesce("doc", F.lit(LAST)).alias("doc"))
    # whole texts: only the first copy goes on, and only one of a document's repeated rows
    first = ids.groupBy("digest").agg(F.min(F.struct("doc", "rid")).alias("one"), F.count("*").alias("c")).where("c > 1").select("digest", "one")
    copies = stash(ids.join(first, "digest").where("rid <> one.rid").select("rid", "doc_id", "th", "n", (F.col("doc") > F.col("one.doc")).alias("later")), "copies")
    skipped = copies.select("rid")
    rows = grams.select("rid", F.arrays_zip("grams", "counts").alias("g")).join(small(skipped, copies.count(), 16), "rid", "left_anti")
    rows = rows.select("rid", F.explode("g").alias("g")).select("rid", F.col("g.grams").alias("gram"), F.col("g.counts").alias("c"))
    # counts are summed before they are shuffled; a join streams the rows of a hot gram past one row, without holding them
    often = rows.groupBy("gram").agg(F.sum("c").alias("total")).where("total > 1")
    wanted = rows.join(often, "gram").select("rid", F.struct("gram", F.ceil(F.col("total") / CAP).cast("int").alias("salts")).alias("s"))
    wanted = wanted.groupBy("rid").agg(F.collect_list("s").alias("s")).join(ids.select("rid", "doc_id", "th", "doc"), "rid")
    wanted = stash(wanted.select("rid", "doc_id", "th", "doc", F.col("s.gram").alias("grams"), F.col("s.salts").alias("salts")), "wanted")
    plain = docs.select("doc_id", text_hash(text).alias("th"), "text")
    met = plain.join(wanted, plain["doc_id"].eqNullSafe(wanted["doc_id"]) & (plain["th"] == wanted["th"])).select("rid", "doc", "grams", "salts", "text")
    cut = stash(met.mapInArrow(K.task(_snippet_rows), "gram long, rid long, doc long, start long, size long, salts long, snippet binary"), "snippets")

    salted = cut.where("snippet is not null").withColumn("salt", F.pmod(F.xxhash64("rid"), F.col("salts")))
    dealt = salted.repartition("gram", "salt").sortWithinPartitions("gram", "salt")
    settled = stash(dealt.mapInArrow(K.task(_shard_rows), "rid long, start long, end long, doc long, salt long, window binary"), "settled")
    open_ = settled.where("window is not null")
    merged = open_.repartitionByRange("window").mapInArrow(K.task(_merge_rows), "rid long, start long, end long")
    spans = (
        cut.where("snippet is null").select("rid", "start", (F.col("start") + F.col("size")).alias("end"))
        .unionByName(settled.where("window is null").select("rid", "start", "end"))
        .unionByName(merged)
    )
    apart = spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(K.task(_merged), "rid long, spans array<struct<start: long, end: long>>")
    apart = apart.join(ids.select("rid", "doc_id", "th"), "rid").select("doc_id", "th", "spans")
    whole = copies.where("later").select("doc_id", "th", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))).alias("spans")).dropDuplicates(["doc_id", "th"])
    found = stash(apart.unionByName(whole), "spans")
    for gone in (*made, copies, wanted, cut, settled):
        drop_stash(gone)
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept, for each row of docs (doc_id, text)."""
    spans = repeats(docs.select("doc_id", "text"))
    volume = spans.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("k")).first()
    spans = small(spans, volume["n"] * 48 + volume["k"] * 24, 1)
    plain = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    both = plain.join(spans, plain["doc_id"].eqNullSafe(spans["doc_id"]) & (plain["th"] == spans["th"]), "left").select(plain["doc_id"], "text", "spans")
    return both.mapInArrow(K.task(_cut_out), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL: dict[str, str] = {}
