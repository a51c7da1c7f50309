"""Benchmark decontamination by a positional inverted index; native column expressions only.

The index is a stored table of postings (document, place, term) of the terms that the benchmark has; other words can't
take part in a match. Benchmark windows are distinct word sequences. For each window the places of its rarest training
term, less the term's offset, are candidate starts; these are intersected with the offset-adjusted places of the next
rarest terms, and what is left with those of all its words, so that a match is exact without a look at the texts.
proximity_matches instead asks that all words of a window lie within its length and some slack.

Candidates are joined by document and place, so that a common passage or term spreads over tasks; benchmark tables
and sets of candidate documents are broadcast only when counted and small, and joined by shuffle beyond.

Defined cases: null or empty texts have no words and no hits; a benchmark item without words has no window; equal items
all count; rows of equal doc_id are told apart by their texts; repeated rows get equal results; an empty benchmark
leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import let, lower_ascii, release_shuffles, small, stash, table, text_hash

WINDOW = 13
#: How many of a window's rarest terms are intersected before all of its words are.
RARE = 2
#: What stands between words while A-Z are still there.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
KEY = ["doc_id", "th"]


def _pieces(text: Column) -> Column:
    """Words in their own case, with an empty string at either end where the text doesn't begin or end with a word."""
    return F.split(F.coalesce(text, F.lit("")), NOT_WORD, -1)


def _lower(word: Column) -> Column:
    """lower() is quick and does A-Z alone where there is nothing but ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(lower_ascii(word))


def word_list(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.transform(F.filter(_pieces(text), lambda w: w != ""), _lower)


def word_count(text: Column) -> Column:
    """How many words a text has."""
    return let(_pieces(text), lambda w: (F.size(w) - (F.get(w, 0) == "").cast("int") - ((F.size(w) > 1) & (F.get(w, F.size(w) - 1) == "")).cast("int")).cast("long"))


def windows_of(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Distinct windows (win, len, ws, items) of the items; a shorter item is one window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), word_list(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))
    # a null id is an item too, but has no name to report
    cut = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i + 1, size))).alias("ws"))
    found = cut.groupBy("ws").agg(F.collect_set("item").alias("items"))
    return stash(found.select(F.monotonically_increasing_id().alias("win"), F.size("ws").alias("len"), "ws", "items"), "windows")


def index_of(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """Postings (doc_id, th, pos, term) of the terms, stored; one pass over the texts. Places count from 0 or from 1."""
    spread = docs.select("doc_id", text_hash(F.col("text")).alias("th"), F.posexplode(_pieces(F.col("text"))).alias("pos", "piece"))
    spread = spread.select("doc_id", "th", "pos", _lower(F.col("piece")).alias("word"))
    return stash(spread.join(small(terms, n_terms, 64), "word").select("doc_id", "th", "pos", "term"), "postings")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _at(found: DataFrame, index: DataFrame, wanted: DataFrame, n_wanted: int) -> DataFrame:
    """Candidates (doc_id, th, win, start, ...) with the words of wanted (win, off, term) that stand in their places."""
    need = found.join(small(wanted, n_wanted, 32), "win").withColumn("pos", F.col("start") + F.col("off"))
    same = _same_document(need, index) & (need["pos"] == index["pos"]) & (need["term"] == index["term"])
    return need.join(index, same).select(need["doc_id"], need["th"], "win", "start", need["off"], need["pos"], "len")


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Places (doc_id, th, win, start, pos) of all words of all exact occurrences, and the windows."""
    windows = windows_of(benchmark, size)
    places = windows.select("win", "len", F.posexplode("ws").alias("off", "word"))
    terms = stash(places.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    n_terms, n_windows = terms.count(), windows.count()
    index = index_of(docs, terms, n_terms)
    release_shuffles(docs.sparkSession)
    often = index.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "off")
    ranked = places.join(terms, "word").join(often, "term", "left").withColumn("rank", F.row_number().over(order)).select("win", "len", "off", "term", "rank")
    ranked = stash(ranked, "ranked-terms")
    n_ranked = n_windows * size
    first = ranked.where("rank = 1").select("win", "len", "off", "term")
    found = index.join(small(first, n_windows, 48), "term").select("doc_id", "th", "win", (F.col("pos") - F.col("off")).alias("start"), "len").where("start >= 0")
    for k in range(2, RARE + 1):
        term_k = ranked.where(F.col("rank") == k).select("win", "off", "term")
        # only postings of these terms, so that the index side of the join is short
        few = index.join(small(term_k.select("term").distinct(), n_terms, 16), "term", "left_semi")
        short = found.where(F.col("len") < k)
        found = _at(found.where(F.col("len") >= k), few, term_k, n_windows).select("doc_id", "th", "win", "start", "len").unionByName(short.select("doc_id", "th", "win", "start", "len"))
    found = stash(found.distinct(), "candidates")
    release_shuffles(docs.sparkSession)
    hot = stash(found.select(*KEY).distinct(), "candidate-documents")
    n_hot = hot.count()
    of_hot = small(hot, n_hot, 40)
    near = index.join(of_hot, _same_document(index, of_hot), "left_semi")
    every = _at(found, near, ranked.select("win", "off", "term"), n_ranked)
    # rows repeated in docs repeat their postings: distinct places decide
    whole = every.distinct().withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "th", "win", "start")))
    return whole.where(F.col("n") == F.col("len")).select("doc_id", "th", "win", "start", "pos"), windows


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int, size: int = WINDOW) -> DataFrame:
    """(doc_id, item): documents where all different words of a window lie within its length plus slack of a place.

    Around each place of the window's rarest term, the other terms' postings within reach are gathered; the span from
    the first to the last needed place must fit.
    """
    windows = windows_of(benchmark, size)
    places = windows.select("win", "len", F.explode(F.array_distinct("ws")).alias("word"))
    terms = stash(places.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
    index = index_of(docs, terms, terms.count())
    often = index.groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("win").orderBy(F.coalesce("n", F.lit(0)), "term")
    ranked = places.join(terms, "word").join(often, "term", "left").withColumn("rank", F.row_number().over(order))
    ranked = ranked.withColumn("need", F.count("*").over(Window.partitionBy("win"))).select("win", "len", "term", "rank", "need")
    anchor = index.join(ranked.where("rank = 1"), "term").select("doc_id", "th", "win", F.col("pos").alias("at"), "len", "need").distinct()
    wide = anchor.join(ranked.select("win", "term"), "win").alias("w")
    same = F.col("w.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("w.th") == F.col("x.th")) & (F.col("w.term") == F.col("x.term"))
    near = wide.join(index.alias("x"), same & (F.abs(F.col("x.pos") - F.col("w.at")) < F.col("w.len") + slack))
    near = near.select("w.doc_id", "w.th", "w.win", "w.at", "w.len", "w.need", "w.term", "x.pos")
    # a window of places fits if, started at one of the gathered places, it holds every term
    begin = near.select("doc_id", "th", "win", "at", F.col("pos").alias("begin")).distinct().alias("b")
    near = near.alias("n")
    one = F.col("n.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("n.th") == F.col("b.th")) & (F.col("n.win") == F.col("b.win")) & (F.col("n.at") == F.col("b.at"))
    fits = near.join(begin, one).where("n.pos >= b.begin").where(F.col("n.pos") < F.col("b.begin") + F.col("n.len") + slack)
    full = fits.groupBy("n.doc_id", "n.th", "n.win", "n.at", "b.begin", "n.need").agg(F.count_distinct("n.term").alias("found")).where("found = need")
    return full.select("doc_id", "win").distinct().join(windows, "win").select("doc_id", F.explode("items").alias("item")).distinct()


def _marks(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """Stored: hit words and items of the documents that have any."""
    places, windows = phrase_matches(docs.select("doc_id", "text"), benchmark, size)
    places = stash(places, "matches")
    release_shuffles(docs.sparkSession)
    hit = places.select(*KEY, "pos").distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    items = places.select(*KEY, "win").distinct().join(windows.select("win", "items"), "win").select(*KEY, F.explode("items").alias("item"))
    items = items.groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = hit.alias("h").join(items.alias("i"), F.col("h.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("h.th") == F.col("i.th")), "left")
    return stash(both.select("h.doc_id", "h.th", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items")), "contamination")


def _verdict(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contaminated_keys(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Stored: (doc_id, th) of the contaminated documents."""
    marks = _marks(docs, benchmark, size).select("doc_id", "th", "n_hit")
    release_shuffles(docs.sparkSession)
    marks = small(marks, marks.count(), 40)
    base = docs.select("doc_id", text_hash(F.col("text")).alias("th"), "text")
    hit = base.join(marks, _same_document(base, marks)).select(base["doc_id"], base["th"], "n_hit", word_count(F.col("text")).alias("n_words"))
    return stash(hit.where(_verdict(F.col("n_hit"), F.col("n_words"))).select("doc_id", "th").distinct(), "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """A row for each row of docs (doc_id, text): words, hit words, items and the verdict."""
    marks = _marks(docs, benchmark, size)
    volume = marks.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("m")).first()
    base = docs.select("doc_id", text_hash(F.col("text")).alias("th"), word_count(F.col("text")).alias("n_words"))
    marks = small(marks, volume["n"] * 40 + volume["m"] * 16, 1)
    out = base.join(marks, _same_document(base, marks), "left").select(base["doc_id"], "n_words", "n_hit", "items")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        _verdict(n_hit, F.col("n_words")).alias("contaminated"),
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontamination": op10_decontamination}
SQL = {
    "op10_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)"""
}
