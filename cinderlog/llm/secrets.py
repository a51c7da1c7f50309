"""Secret scans: candidates by their form, and a random forest that removes false positives.

A candidate is a run of letters, digits and _-+/=. that is long and holds a digit, that begins like an issuer's keys, or
that stands right after a sign of assignment; an assigned value with other signs reaches to its quote or blank (a next
name with its sign ends it, and closing signs after it without a quote don't count; URLs stay runs). A block between the
marks of a private key is one candidate. Its features are length, character transitions (changes of class, and how much likelier its letter pairs
are among secrets than among other runs), the share covered by dictionary words, path and address signs, and the
neighbouring words. The forest learns from labelled findings: labelled_findings() makes a fixed set by rules, and a
table of one's own findings (text, start, end, label) can be given instead.

Candidates are found on byte buffers of whole texts, by slices of a few MB; nothing is shuffled.

Defined cases: a null text stays null and has no findings, an empty one has none; a null doc_id is kept; texts of any
length are whole; repeated rows get equal results; a score at the threshold is a secret, and of equally good cuts a tree
takes the first it tries; an empty table gives no rows; scan() and redact() keep all other columns as they are.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import kernels as K
from cinderlog.llm.common import table

FINDINGS, TREES, DEPTH, LEAF = 6_000, 40, 9, 4
#: Least lengths: of a run with a digit, and of an assigned or issued one.
LONG, ASSIGNED = 16, 8
#: Share of trees that must say so.
THRESHOLD = 0.5
MASK = "[SECRET]"
#: Characters on each side that are read as neighbours.
AROUND = 48

RUN = np.zeros(256, bool)
RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-+/."]] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True

# fixed values: words that name secrets, words beside harmless hashes, and common words inside identifiers and paths
NAMES = "token secret password passwd pwd apikey api_key access_key auth credential private key bearer client_secret signature".split()
HARMLESS = "md5 sha1 sha256 checksum commit digest etag uuid guid example sample dummy version build revision order invoice phone tel fax isbn card call".split()
DICTIONARY = "the and for with from that this have will your about which when make like time just know take people into year good some could them other than then look only come over think also back after work first well even want because these give most user name file path home test data main index page image static assets config server client admin public include build release version example local document report module package service system value table query".split()
#: Starts of keys of known issuers.
ISSUERS = "AKIA ASIA ghp_ gho_ ghs_ xoxb- xoxp- sk- sk_live_ pk_live_ AIza glpat- npm_ eyJ SG.".split()
#: A sign of assignment and its value; a name with its sign that begins a value; one that follows it.
VALUE = re.compile(rb"[=:][ \"'`]{0,2}([^\s\"'`=:][^\s\"'`]*)")
#: A private key between its marks; a whole block is one candidate.
KEY_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----.*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----", re.DOTALL)
INNER, NEXT = re.compile(rb"[A-Za-z_][\w.-]*=(?=[^=])"), re.compile(rb"[?&,;|#][A-Za-z_][\w.-]*[=:]")

FEATURES = ("length", "changes", "pair_odds", "entropy", "digits", "uppers", "lowers", "signs", "hex", "dictionary", "slashes", "dots", "extension", "address", "assigned", "quoted", "secret_word", "harmless_word", "issuer", "all_digits")


def _values(text: bytes) -> Iterator[tuple[int, int]]:
    """Starts and ends of key blocks, and of assigned values that hold other signs than those of runs."""
    blocks = [m.span() for m in KEY_BLOCK.finditer(text)] if b"-----BEGIN " in text else []
    at = 0
    while found := VALUE.search(text, at):
        a, b = found.span(1)
        if blocks and b > blocks[0][0]:
            # what begins before a block and reaches into it belongs to it
            yield blocks[0]
            at = blocks.pop(0)[1]
            continue
        value = text[a:b]
        if value.startswith(b"//") or INNER.match(value):
            at = a
            continue
        if cut := NEXT.search(value):
            value = value[: cut.start()]
        if text[a - 1] not in b"\"'`":
            value = value.rstrip(b",;.)]}>")
        at = a + max(1, len(value))
        if len(value) >= ASSIGNED and not RUN[np.frombuffer(value.rstrip(b"="), np.uint8)].all():
            yield a, a + len(value)
    yield from blocks


def candidates(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of candidates in texts of one buffer."""
    starts, ends = K.runs(RUN[data], off)
    keep = ends - starts >= ASSIGNED
    starts, ends = starts[keep], ends[keep]
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    has_digit = digits[ends] > digits[starts]
    # the sign before, beyond quotes and a blank
    doc_start = off[np.searchsorted(off, starts, "right") - 1]
    at = starts - 1
    for _ in range(2):
        skip = (at >= doc_start) & np.isin(data[np.maximum(at, 0)], [0x20, 0x22, 0x27, 0x60])
        at = np.where(skip, at - 1, at)
    assigned = (at >= doc_start) & np.isin(data[np.maximum(at, 0)], [0x3A, 0x3D])
    issued = np.zeros(len(starts), bool)
    eights = K.eights(data)
    for name in ISSUERS:
        issued |= eights[starts] & K._MASK[len(name)] == np.uint64(int.from_bytes(name.encode(), "little"))
    found = (has_digit & (ends - starts >= LONG)) | assigned | issued
    starts, ends = starts[found], ends[found]
    # '=' at the end is padding
    doc_end = off[np.searchsorted(off, starts, "right")]
    for _ in range(2):
        ends = np.where((ends < doc_end) & (data[np.minimum(ends, len(data) - 1)] == 0x3D), ends + 1, ends)
    # whole values in place of the runs that they hold
    whole = [(a + lo, a + hi) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True) for lo, hi in _values(data[a:b].tobytes())]
    if not whole:
        return starts, ends
    first, last = np.array(whole, np.int64).T
    k = np.searchsorted(first, ends, "left") - 1  # the last value that begins before a run's end
    free = (k < 0) | (last[np.maximum(k, 0)] <= starts)
    starts, ends = np.concatenate([starts[free], first]), np.concatenate([ends[free], last])
    order = np.argsort(starts)
    return starts[order], ends[order]


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(value: str, left: str, right: str, odds: dict[str, float]) -> list[float]:
    """FEATURES of a candidate between its neighbours."""
    n = len(value)
    bare = value.rstrip("=.")
    classes = [_class(c) for c in bare] or [3]
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False)) / max(1, len(classes) - 1)
    count = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    low = value.lower()
    covered = 0
    for w in DICTIONARY:
        covered += len(w) * low.count(w)
    pairs = [odds.get(low[i : i + 2], 0.0) for i in range(n - 1)]
    before, beside = left.lower(), (left + " " + right).lower()
    last = before.rstrip(" \"'`")
    near = last[-24:]
    return [
        n,
        changes,
        sum(pairs) / max(1, len(pairs)),
        entropy,
        sum(c.isdigit() for c in value) / n,
        sum(c.isupper() for c in value) / n,
        sum(c.islower() for c in value) / n,
        sum(not c.isalnum() for c in value) / n,
        float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare) is not None),
        min(1.0, covered / n),
        value.count("/"),
        bare.count("."),
        float(re.search(r"\.[a-z]{2,4}$", low) is not None),
        float("://" in left[-12:] or left.endswith("@") or right.startswith("@") or low.startswith("//") or "www." in low),
        float(last.endswith(("=", ":"))),
        float(left.endswith(('"', "'", "`"))),
        float(any(w in near for w in NAMES)),
        float(any(w in beside for w in HARMLESS)),
        float(value.startswith(tuple(ISSUERS))),
        float(bare.replace("-", "").isdigit()),
    ]


def labelled_findings(rows: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): secrets and look-alikes made by rules, in invented sentences; always the same."""
    r = random.Random(seed)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, up, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(r.choice(["er", "th", "an", "in", "ou", "le", "de", "on", "re", "st", "la", "ge"]) for _ in range(r.randint(1, 4)))
    words = lambda: " ".join(word() for _ in range(r.randint(0, 9)))
    name = lambda: r.choice(["token", "secret", "password", "api_key", "access_key", "client_secret", "auth_token", "passwd", "private_key"])
    sign = lambda: r.choice(["=", ": ", ' = "', '="', ": '", " = "])
    kind = lambda: r.choice(["RSA ", "EC ", "", "OPENSSH ", "ENCRYPTED "])
    pem = lambda: (lambda k: f"-----BEGIN {k}PRIVATE KEY-----\n" + "\n".join(some(alnum + "+/", 64) for _ in range(r.randint(1, 6))) + f"\n-----END {k}PRIVATE KEY-----")(kind())
    positive = [
        lambda: (f"{name()}{sign()}", some(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: (f"{name()}{sign()}", some(alnum, r.randint(12, 48))),
        lambda: (f"{name()}{sign()}", some(alnum + "+/", r.choice([40, 44, 64])) + r.choice(["", "=", "=="])),
        lambda: (r.choice(["", "", "key ", "id: ", f"{name()}="]), "AKIA" + some(up, 16)),
        lambda: (r.choice(["", "", "use ", f"{name()}="]), r.choice(["ghp_", "gho_", "npm_", "glpat-", "sk_live_", "xoxb-", "sk-", "AIza"]) + some(alnum, r.randint(24, 36))),
        lambda: (f"{name()}{sign()}", some(letters, r.randint(10, 32))),
        lambda: (f"{name()}{sign()}", "".join(word() for _ in range(4)) + some(letters[26:], r.randint(4, 12))),
        lambda: (f"{name()}{sign()}", some(alnum, r.randint(4, 10)) + r.choice("&!@#$%*^~") + some(alnum + "&!@#$%*^~", r.randint(4, 14))),
        lambda: (r.choice(["", "use ", "key: "]), r.choice(["AKIA", "ASIA"]) + some(letters[:26], 16)),
        lambda: (r.choice(["", "key: ", "private_key = "]), pem()),
        lambda: (r.choice(["Bearer ", "token: "]), "eyJ" + some(alnum, 24) + "." + some(alnum, 40) + "." + some(alnum + "-_", 30)),
    ]
    negative = [
        lambda: (r.choice(["", "id ", "uuid ", "guid: "]), "-".join(some(hexa, n) for n in (8, 4, 4, 4, 12))),
        lambda: (r.choice(["commit ", "sha1: ", "md5 = ", "checksum ", "etag: ", "digest="]), some(hexa, r.choice([32, 40, 64]))),
        lambda: (r.choice(["", "", "card ", "order ", "tel: "]), some("0123456789", r.randint(10, 20))),
        lambda: (r.choice(["", "see ", "in ", "path: "]), "/".join(["", "home", word(), word() + some("0123456789", 2), word() + "." + r.choice(["py", "txt", "html", "json"])])),
        lambda: (r.choice(["https:", "http:"]), "//www." + word() + some("0123456789", 1) + ".com/" + word() + "/" + word()),
        lambda: (some("0123456789", 2) + "@", "mail" + some("0123456789", 1) + ".example.com"),
        lambda: (r.choice(["", "version: ", "build = "]), ".".join(str(r.randint(0, 40)) for _ in range(3)) + "-" + word() + "." + some("0123456789", 4)),
        lambda: (r.choice(["", "at ", "date: "]), f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}"),
        lambda: (r.choice(["", "", "name=", "value: "]), "_".join([word(), word(), word(), some("0123456789", r.randint(1, 3))])),
        lambda: (f"{name()}{sign()}", r.choice(["example", "your_token_here", "dummy", "sample"]) + "-" + word() + some("0123456789", 1) + word()),
        lambda: ("", word() + word() + word() + word() + "." + some("0123456789", 2)),
        lambda: (r.choice(["file ", "image "]), word() + "-" + word() + "-" + some("0123456789", 3) + ".png"),
        lambda: (f"{word()}{word()}{sign()}", r.choice([word, lambda: r.choice(DICTIONARY)])() + r.choice(["", "-", "_"]) + word() + word() + word()),
        lambda: (f"{word()}{word()}{r.choice(['=', ': ', ' = '])}", word() + r.choice(["(", "[", "&", "%20", "|", "*"]) + word() + r.choice(["", ",", "->"]) + word() + some("0123456789", r.randint(0, 2))),
        lambda: (r.choice(["time: ", "at: ", "date="]), ":".join(some("0123456789", 2) for _ in range(r.randint(3, 4)))),
        lambda: (r.choice(["count: ", "total = ", "n="]), some("0123456789", r.randint(8, 12))),
    ]
    out = []
    for k in range(rows):
        lead, value = r.choice(positive if k % 2 else negative)()
        before = f"{words()} {lead}"
        out.append((f"{before}{value}{r.choice(['', ' ', chr(34) + ' ', '. '])}{words()}", len(before), len(before) + len(value), k % 2))
    return out


class Forest:
    """Bagged trees of random features; each node takes the cut of least Gini impurity among a few quantiles."""

    def __init__(self, findings: list[tuple[str, int, int, int]], seed: int = 3) -> None:
        seen = {0: {}, 1: {}}
        for text, a, b, label in findings:
            low = text[a:b].lower()
            for i in range(len(low) - 1):
                seen[label][low[i : i + 2]] = seen[label].get(low[i : i + 2], 0) + 1
        total = [sum(seen[k].values()) + 1 for k in (0, 1)]
        self.odds = {p: math.log((seen[1].get(p, 0) + 1) / total[1]) - math.log((seen[0].get(p, 0) + 1) / total[0]) for p in sorted({*seen[0], *seen[1]})}
        x = np.array([self.row(t, a, b) for t, a, b, _ in findings], float).reshape(-1, len(FEATURES))
        y = np.array([label for *_, label in findings], float)
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[int, float, int, int, float]] = []  # feature, cut, children, share of secrets
        self.roots = np.array([self._grow(x[i], y[i], rng, 0) for i in (rng.integers(0, len(y), len(y)) for _ in range(TREES))], np.int64) if len(y) else np.zeros(0, np.int64)
        self.feature, self.cut, self.low, self.high, self.share = (np.array(c) for c in zip(*self.nodes, strict=True)) if self.nodes else [np.zeros(0)] * 5

    def row(self, text: str, a: int, b: int) -> list[float]:
        return describe(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], self.odds)

    def _grow(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        """Adds a node and those below it; the number of the node. A leaf is its own child."""
        me = len(self.nodes)
        self.nodes.append((0, np.inf, me, me, float(y.mean())))
        if depth == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
            return me
        best = (np.inf, None, None)
        for f in rng.choice(x.shape[1], 6, replace=False):
            v = x[:, f]
            for cut in np.unique(np.quantile(v, np.linspace(0.04, 0.96, 16))):
                low = v <= cut
                n = int(low.sum())
                if LEAF <= n <= len(y) - LEAF:
                    p, q = y[low].mean(), y[~low].mean()
                    impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                    if impurity < best[0]:
                        best = (impurity, f, cut)
        if best[1] is None:
            return me
        low = x[:, best[1]] <= best[2]
        left, right = (self._grow(x[k], y[k], rng, depth + 1) for k in (low, ~low))
        self.nodes[me] = (int(best[1]), float(best[2]), left, right, float(y.mean()))
        return me

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """For each row the mean share of secrets in the leaves that it comes to; all trees and rows go down abreast."""
        if not len(self.roots) or not len(rows):
            return np.zeros(len(rows))
        at = np.tile(self.roots, (len(rows), 1))
        for _ in range(DEPTH):
            value = np.take_along_axis(rows, self.feature[at].astype(np.int64), 1)
            at = np.where(value <= self.cut[at], self.low[at], self.high[at])
        return self.share[at].mean(1)

    def score(self, row: list[float]) -> float:
        return float(self.scores(np.array([row], float))[0])


def findings_in(forest: Forest, data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """For each text its candidates (start byte, end byte, score)."""
    starts, ends = candidates(data, off)
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(off) - 1)]
    docs = np.searchsorted(off, starts, "right") - 1
    rows = []
    for d, a, b in zip(docs.tolist(), starts.tolist(), ends.tolist(), strict=True):
        lo, hi = int(off[d]), int(off[d + 1])
        left = data[max(lo, a - AROUND) : a].tobytes().decode("utf-8", "ignore")
        right = data[b : min(hi, b + AROUND)].tobytes().decode("utf-8", "ignore")
        rows.append(describe(data[a:b].tobytes().decode("utf-8", "ignore"), left, right, forest.odds))
    scores = forest.scores(np.array(rows, float).reshape(-1, len(FEATURES)))
    for d, a, b, p in zip(docs.tolist(), starts.tolist(), ends.tolist(), scores.tolist(), strict=True):
        out[d].append((a - int(off[d]), b - int(off[d]), p))
    return out


def _scanned(docs: DataFrame, forest: Forest, keep: list[str], schema: str, made) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            data, off = K.buffers(text)
            for a, b in K.slices(off):
                part, border = K.cut(data, off, a, b)
                columns = made(part, border, text[a:b], findings_in(shared.value, part, border))
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in keep), *columns.values()], names=[*keep, *columns])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, docs["text"]).mapInArrow(K.task(run), ", ".join([*kept, schema]))


def _mask(blob: bytes, found: list[tuple[int, int, float]], threshold: float) -> bytes:
    out, at = [], 0
    for a, b, p in found:
        if p >= threshold:
            out += [blob[at:a], MASK.encode()]
            at = b
    return b"".join([*out, blob[at:]])


def scan(docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs but the text, with the candidates (start and end byte, score, secret or not)."""
    keep = [c for c in docs.columns if c != "text"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("secret", pa.bool_())]))

    def made(data, off, texts, found):
        return {"findings": pa.array([[{"start": a, "end": b, "score": p, "secret": p >= threshold} for a, b, p in x] for x in found], kind)}

    forest = Forest(labelled_findings() if findings is None else findings)
    return _scanned(docs, forest, keep, "findings array<struct<start: long, end: long, score: double, secret: boolean>>", made)


def redact(docs: DataFrame, findings: list[tuple[str, int, int, int]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret replaced by MASK; the columns and their order stay."""
    keep = [c for c in docs.columns if c != "text"]

    def made(data, off, texts, found):
        blobs = [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        masked = [_mask(x, f, threshold).decode() if t.is_valid else None for x, f, t in zip(blobs, found, texts, strict=True)]
        return {"text": pa.array(masked, pa.string())}

    forest = Forest(labelled_findings() if findings is None else findings)
    return _scanned(docs, forest, keep, "text string", made).select(*(F.col(f"`{c}`") for c in docs.columns))


def digests(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, candidates, secrets, their bytes, and a digest of the text without them."""

    def made(data, off, texts, found):
        secret = [[f for f in x if f[2] >= threshold] for x in found]
        cut = [hashlib.sha256(_mask(data[a:b].tobytes(), x, threshold)).hexdigest() for a, b, x in zip(off[:-1].tolist(), off[1:].tolist(), found, strict=True)]
        return {
            "n_candidates": pa.array([len(x) for x in found], pa.int64()),
            "n_secrets": pa.array([len(x) for x in secret], pa.int64()),
            "spans": pa.array([",".join(f"{a}-{b}" for a, b, _ in x) for x in secret], pa.string()),
            "redacted_sha256": pa.array(cut, pa.string()),
        }

    return _scanned(docs.select("doc_id", "text"), Forest(labelled_findings()), ["doc_id"], "n_candidates long, n_secrets long, spans string, redacted_sha256 string", made)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secret_scans": op4_secret_scans}
SQL: dict[str, str] = {}
