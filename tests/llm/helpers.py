"""Small tables and plain versions of the operators' contracts."""

import hashlib
import random
import re
import zlib

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, first=0):
    """Documents of the texts; with columns whose names could clash."""
    rows = [(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """df with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    names = ("th", "key", "sig", "n", "shard", "bucket", "word", "pos", "term", "rid", "label", "node", "score", "kept", "spans", "start", "win")
    return df.withColumns({c: F.lit("x") for c in names})


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def lower_ascii(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def sha(b):
    return hashlib.sha256(b).hexdigest()


def sentence(r, n, words=None):
    words = words or ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    return " ".join(r.choice(words) for _ in range(n))


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 7))) for _ in range(n)]


ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "A\x00b", "word " * 3, "x" * 5000, "🙂 ñandú 日本語"]
