"""Quality rules as a learned decision list; native column expressions only.

Statistics of a text are counted by array functions within its row. The rules come from labelled statistics: Spark cuts
each statistic of a bounded sample at quantiles and counts labels by cell, and sequential covering over those counts
grows a conjunction of thresholds at a time by information gain on two thirds of the rows, prunes it on the rest and
removes what it covers. The list becomes one ordered conditional expression.

Learning takes at most SAMPLE labelled rows (those of least hash of doc_id), so the driver gets at most that many cells;
scoring covers every row and whole texts.

Defined cases: a null text has no words, lines or symbols, and so fails the base rule like any text of under 50 words;
several labels of one doc_id all count; without labels of both kinds the list is empty and only the base rule decides;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.common import SPACE, UPPER, labelled_sample, let, stash, table

SAMPLE = 8_000
#: Cut points of a statistic for each label.
CUTS = 16
#: Least precision of a rule on the rows that it was pruned on, least rows that it covers, most conditions and rules.
PRECISION, COVER, CONDITIONS, RULES = 0.97, 8, 4, 12
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
#: Up to so many different repeated windows, membership is tested value by value; beyond, windows are sorted with positions.
FEW = 48
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "shouts", "marks")


def _covered(at: Column) -> Column:
    """How many words windows of three cover that start at these sorted places."""
    steps = F.transform(at, lambda p, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(at, i - 1))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeats(w: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def of(h: Column) -> Column:
        def by_value(sorted_: Column) -> Column:
            twice = F.array_distinct(F.filter(sorted_, lambda x, i: (i > 0) & (x == F.get(sorted_, i - 1))))
            return let(twice, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).when(F.size(d) <= FEW, let(F.filter(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i)), lambda i: i.isNotNull()), _covered)).otherwise(by_place()))

        def by_place() -> Column:
            def pick(s: Column) -> Column:
                same = F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
                return let(F.sort_array(F.transform(same, lambda x: x["i"])), _covered)

            return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), pick)

        return let(F.sort_array(h), by_value)

    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows, of))


def _without(text: Column, marks: str) -> Column:
    return F.translate(text, marks, "")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, a row for a row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    bare = F.btrim(t, F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    by_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeats(w).alias("r")))
    counted = docs.select(
        "doc_id",
        by_word.alias("by_word"),
        F.length(_without(t, BLANKS)).cast("long").alias("word_chars"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("by_line"),
        (F.length(t) - F.length(_without(t, UPPER))).alias("n_capitals"),
        (F.length(t) - F.length(_without(t, "!"))).alias("n_shouts"),
        (F.length(t) - F.length(_without(t, ".,;:?\"'()"))).alias("n_marks"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counted.select(
        "doc_id",
        F.col("by_word.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("by_line.dup").alias("n_dup_lines"),
        F.col("by_word.r").alias("n_repeat_words"),
        F.col("by_line.n").alias("n_lines"),
        "n_capitals",
        "n_shouts",
        "n_marks",
    ).withColumns(
        {
            "words": F.col("n_words").cast("double"),
            "word_length": F.col("word_chars") / n,
            "symbols": F.col("n_symbols") / n,
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeats": F.col("n_repeat_words") / n,
            "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
            "shouts": F.col("n_shouts") / n,
            "marks": F.col("n_marks") / n,
        }
    )


@dataclass(frozen=True)
class Condition:
    """statistic > cut, or <= cut."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.cut if self.above else F.col(self.statistic) <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]
#: A cell: bin numbers, label (1 is a text to reject), fold (True: for pruning), rows.
Cell = tuple[tuple[int, ...], int, bool, int]


def _holds(bins: tuple[int, ...], test: list[tuple[int, bool, int]]) -> bool:
    return all(bins[f] > b if above else bins[f] <= b for f, above, b in test)


def _count(cells: list[Cell], test: list[tuple[int, bool, int]]) -> tuple[int, int]:
    hit = [0, 0]
    for bins, label, _, n in cells:
        if _holds(bins, test):
            hit[label] += n
    return hit[1], hit[0]


def _grow(cells: list[Cell]) -> list[tuple[int, bool, int]]:
    """Adds the condition of most information gain until no wrong row is left."""
    test: list[tuple[int, bool, int]] = []
    while len(test) < CONDITIONS:
        held = [c for c in cells if _holds(c[0], test)]
        p0 = sum(n for _, label, _, n in held if label)
        n0 = sum(n for _, label, _, n in held if not label)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f in range(len(held[0][0])):
            by_bin: dict[int, list[int]] = defaultdict(lambda: [0, 0])
            for bins, label, _, n in held:
                by_bin[bins[f]][label] += n
            below = [0, 0]
            for b in sorted(by_bin)[:-1]:
                below = [below[0] + by_bin[b][0], below[1] + by_bin[b][1]]
                for above, p, q in ((False, below[1], below[0]), (True, p0 - below[1], n0 - below[0])):
                    if p and (g := p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + n0)))) > gain:
                        best, gain = (f, above, b), g
        if best is None:
            break
        test.append(best)
    return test


def _prune(test: list[tuple[int, bool, int]], cells: list[Cell]) -> list[tuple[int, bool, int]]:
    """The prefix that does best on the rows kept back."""

    def worth(t: list[tuple[int, bool, int]]) -> float:
        p, n = _count(cells, t)
        return (p - n) / (p + n) if p + n else -1.0

    return max((test[:k] for k in range(len(test), 0, -1)), key=worth, default=[])


def cover(cells: list[Cell], cuts: list[list[float]]) -> list[Rule]:
    """Sequential covering: a list of rules for label 1, each learned on the rows that those before it leave."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        grown = _grow([c for c in cells if not c[2]])
        test = _prune(grown, [c for c in cells if c[2]]) if grown else []
        if not test:
            break
        p, n = _count(cells, test)
        kept_p, kept_n = _count([c for c in cells if c[2]], test)
        if p + n < COVER or p < PRECISION * (p + n) or kept_p < PRECISION * (kept_p + kept_n):
            break
        rules.append(tuple(Condition(STATISTICS[f], above, cuts[f][b]) for f, above, b in test))
        cells = [c for c in cells if not _holds(c[0], test)]
    return rules


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < value))


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[Rule]:
    """The decision list of a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True), rows).withColumnRenamed("label", "quality")
    known = measure(sample.select(F.struct("doc_id", "quality").alias("doc_id"), "text"))
    known = stash(known.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.quality").alias("quality"), *STATISTICS), "rule-statistics")
    at = [k / CUTS for k in range(1, CUTS)]
    by_label = known.groupBy("quality").agg(*(F.percentile_approx(s, [0.002, *at, 0.998], 10_000).alias(s) for s in STATISTICS)).collect()
    if len(by_label) < 2:
        return []
    cuts = [sorted({float(x) for r in by_label for x in r[s]}) for s in STATISTICS]
    bins = [_bin(F.col(s), c).alias(f"b_{s}") for s, c in zip(STATISTICS, cuts, strict=True)]
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("fold")
    counted = known.select(*bins, (1 - F.col("quality")).alias("label"), fold).groupBy(*(f"b_{s}" for s in STATISTICS), "label", "fold").agg(F.count("*").alias("n"))
    cells = sorted((tuple(r[: len(STATISTICS)]), r["label"], r["fold"], r["n"]) for r in counted.collect())
    # a value in bin b is above the b cuts before it: bin <= b means value <= cuts[b], bin > b means value > cuts[b]
    return cover(cells, cuts)


def _test(rule: Rule) -> Column:
    test = rule[0].column()
    for c in rule[1:]:
        test = test & c.column()
    return test


def rule_number(rules: list[Rule]) -> Column:
    """The first rule that holds, from 1; 0 where none does: one ordered conditional expression."""
    out: Column | None = None
    for k, rule in enumerate(rules, 1):
        out = F.when(_test(rule), F.lit(k)) if out is None else out.when(_test(rule), F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        measure(docs.select("doc_id", "text"))
        .withColumns({"base_failed": failed, "rule": rule_number(rules)})
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op7_quality_rules": op7_quality_rules}
SQL: dict[str, str] = {}
