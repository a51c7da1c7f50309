"""Sharding by a weighted hash tree of regions, racks and shards; native column expressions only.

At every level each child of the chosen node draws -ln(u) / weight from a hash of the document's key and the
child's path; the smallest draw wins. A draw depends on its own child's path and weight alone, so a change of
weight moves rows into or out of that subtree and nowhere else. Growth by one shard adds a region that holds
only it: every other draw stays as it was, so rows move into the new shard alone.

Defined cases: a null text has no bytes and no checksum of its own (that of the empty text); a null doc_id is a
key like any other; repeated rows lie in one shard, in neighbouring slots; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog.llm.common import stash, table, utf8_bytes

#: Shards, in 5 regions of 2 racks of 4.
SHARDS = 40
#: Rows for which one slot window is meant to hold a bucket of a shard.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Topology:
    """weights[region][rack][shard]; shards count in reading order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, shards: int, racks: int = 2, per_rack: int = 4) -> Topology:
        """Whole regions first; each shard left over is a region of its own."""
        whole, rest = divmod(shards, racks * per_rack)
        return cls(tuple(tuple((1.0,) * per_rack for _ in range(racks)) for _ in range(whole)) + (((1.0,),),) * rest)

    def grown(self, weight: float = 1.0) -> Topology:
        return Topology((*self.weights, ((weight,),)))

    def __len__(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)


def _draw(key: Column, level: str, parent: Column, child: int, weight: Column) -> Column:
    """An exponential draw with the weight as its rate; a child without weight never wins."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), parent, F.lit(child)), 11).cast("double")
    return F.when(weight > 0, -F.log((bits + F.lit(1.0)) / F.lit(2.0**53 + 1)) / weight)


def _descend(df: DataFrame, key: Column, level: str, parent: Column, weights: list[list[float]], to: str) -> DataFrame:
    """Adds the child of parent that wins; weights[p] are those of the children of parent p."""
    width = max(map(len, weights))
    flat = F.array(*(F.lit(float(w)) for row in weights for w in [*row, *[0.0] * (width - len(row))]))
    draws = [_draw(key, level, parent, j, F.element_at(flat, parent * width + (j + 1))) for j in range(width)]
    least = F.array_min(F.array(*(F.when(d.isNotNull(), F.struct(d.alias("d"), F.lit(j).alias("j"))) for j, d in enumerate(draws))))
    return df.withColumn(to, least["j"])


def place(df: DataFrame, tree: Topology, key: Column, to: str) -> DataFrame:
    """Adds the shard of each key: three draws, each among the children of the node chosen before."""
    racks = max(map(len, tree.weights))
    first, leaves, seen = [], [], 0
    for region in tree.weights:
        for rack in [*region, *[()] * (racks - len(region))]:
            first.append(seen)
            leaves.append(list(rack) or [0.0])
            seen += len(rack)
    df = _descend(df, key, "region", F.lit(0), [[sum(map(sum, region)) for region in tree.weights]], "_region")
    df = _descend(df, key, "rack", F.col("_region"), [[sum(rack) for rack in region] for region in tree.weights], "_rack")
    node = F.col("_region") * racks + F.col("_rack")
    df = _descend(df, key, "shard", node, leaves, "_leaf")
    start = F.element_at(F.array(*map(F.lit, first)), node + 1)
    return df.withColumn(to, (start + F.col("_leaf")).cast("int")).drop("_region", "_rack", "_leaf")


def _buckets(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // (SHARDS * BUCKET_ROWS)))


def assign(docs: DataFrame, tree: Topology | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, checksum, shard, slot and the shard after growth, one row for each row of docs.

    Slots are numbered by buckets of each shard: a bucket's rows are ranked in a task of their own, and the counts of
    the buckets before it are added, so that no task ever sees a whole shard.
    """
    tree = tree or Topology.even(SHARDS)
    known = F.coalesce(F.col(text), F.lit(""))
    id_ = F.col(key)
    slim = docs.select(
        id_.alias("doc_id"),
        (utf8_bytes(F.col(text)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(known.cast("binary")).cast("long").alias("text_crc32"),
    )
    hashed = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    slim = place(place(slim, tree, hashed, "shard"), tree.grown(), hashed, "grown_shard")
    slim = stash(slim, "shards")
    per_shard = _buckets(slim)
    spread = F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(per_shard)).cast("int")
    slim = slim.withColumn("bucket", spread)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = slim.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        slim.withColumn("rank", rank)
        .join(F.broadcast(starts) if per_shard <= 10_000 else starts, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding}
SQL: dict[str, str] = {}
