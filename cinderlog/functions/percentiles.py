"""Percentiles of operation times, by the two rules in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ring_percentile(samples: Column, p: float) -> Column:
    """Of an array of recent samples: the element at floor(n p) in order (the last at most), rounded; 0 if there are none."""
    ordered = F.sort_array(samples)
    n = F.size(samples)
    place = F.least(n, F.floor(n * F.lit(p)).cast("int") + 1)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(F.round(F.get(ordered, place - 1)).cast("long"))


def nearest_rank(column: str, p: float) -> Column:
    """The aggregate: the least value of a column with at least the share p of values at or below it; holds a group's distinct values."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")


def nearest_ranks(samples: DataFrame, group: str, column: str, shares: tuple[float, ...], ranges: int = 256) -> DataFrame:
    """A row for each group with p50, p95, ... by nearest rank, exact, however many values a group has.

    Values are counted first. An approximate summary cuts them into ranges; counts by range say in which one each rank
    lies, and only the values of that range are put in order. Nulls don't count.
    """
    cut = F.percentile_approx("v", F.array(*(F.lit(k / ranges) for k in range(1, ranges))), 4 * ranges)
    counts = samples.where(F.col(column).isNotNull()).groupBy(F.col(group).alias("g"), F.col(column).alias("v")).agg(F.count("*").alias("c"))
    edges = counts.groupBy("g").agg(F.array_distinct(cut).alias("edges"))
    counts, edges = counts.alias("c"), edges.alias("e")
    ranged = counts.join(edges, F.col("c.g").eqNullSafe(F.col("e.g"))).select("c.g", "v", "c", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("r"))
    below = Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    by_range = ranged.groupBy("g", "r").agg(F.sum("c").alias("n"))
    by_range = by_range.select("g", "r", "n", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    # rank: the least whole number of at least p * total, and 1 at least
    asked = by_range.select("*", F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.ceil(F.round(F.col("total") * F.lit(p), 6)), F.lit(1)).alias("rank")) for p in shares))).alias("q"))
    asked = asked.where((F.col("q.rank") > F.col("before")) & (F.col("q.rank") <= F.col("before") + F.col("n"))).select("g", "r", "before", "q.p", "q.rank").alias("a")
    inside = ranged.alias("v").join(asked, F.col("v.g").eqNullSafe(F.col("a.g")) & (F.col("v.r") == F.col("a.r")))
    upto = F.sum("v.c").over(Window.partitionBy("a.g", "a.p").orderBy("v.v"))
    reached = inside.select(F.col("a.g").alias("g"), F.col("a.p").alias("p"), "v.v", (F.col("a.before") + upto).alias("upto"), "a.rank").where("upto >= rank")
    return reached.groupBy(F.col("g").alias(group)).agg(*(F.min(F.when(F.col("p") == p, F.col("v"))).alias(f"p{round(p * 100)}") for p in shares))
