"""Synthetic logs of any size, the same for a seed, and the same rows in SQL.

A value depends on its row, the seed and the column alone: it is a number from the md5 of these, so that neither the
partitioning nor the engine matters. Services, levels with their weights and regions are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Bits of a number from a hash: seven digits of the md5, so that its product with a span of milliseconds is exact.
BITS = 28


@dataclass(frozen=True)
class Shape:
    """What logs are made of; a level is taken in proportion to its weight."""

    services: tuple[str, ...] = ("basket", "ledger", "courier", "atlas")
    levels: tuple[tuple[str, int], ...] = (("info", 6), ("debug", 3), ("warn", 2), ("error", 1))
    regions: tuple[str, ...] = ("north", "south", "east", "west")
    users: int = 5_000

    def by_weight(self) -> list[str]:
        return [name for name, weight in self.levels for _ in range(weight)]


SHAPE = Shape()


def generate(spark: SparkSession, rows: int, end: int, days: int = 30, seed: int = 1, partitions: int | None = None, shape: Shape = SHAPE) -> DataFrame:
    """rows logs in the days before end (microseconds), spread evenly."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    number = F.col("id").cast("string")

    def uniform(k: int) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", number, F.lit(seed), F.lit(k)).cast("binary")), 1, 7), 16, 10).cast("long")

    def choose(values: list[str] | tuple[str, ...], k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (uniform(k) % len(values) + 1).cast("int"))

    return base.select(
        "id",
        F.timestamp_micros(F.lit(end - days * DAY) + F.shiftright(uniform(0) * F.lit(days * DAY // 1000), BITS) * 1000).alias("timestamp"),
        choose(shape.by_weight(), 1).alias("level"),
        choose(shape.services, 2).alias("service"),
        F.concat(F.lit("entry "), number).alias("message"),
        F.create_map(F.lit("user"), (uniform(3) % shape.users).cast("string"), F.lit("region"), choose(shape.regions, 4), F.lit("trace"), F.md5(number.cast("binary"))).alias("attributes"),
    )


def sql(rows: int, end: int, days: int = 30, seed: int = 1, shape: Shape = SHAPE) -> str:
    """The same rows as a WITH clause named made, for DuckDB."""
    uniform = lambda k: f"CAST('0x' || substr(md5(id || ':{seed}:{k}'), 1, 7) AS BIGINT)"
    choose = lambda values, k: f"list_extract({list(values)!r}, {uniform(k)} % {len(values)} + 1)"
    return f"""WITH made AS (
  SELECT id, make_timestamp({end - days * DAY} + ({uniform(0)} * {days * DAY // 1000} >> {BITS}) * 1000) AS timestamp,
    {choose(shape.by_weight(), 1)} AS level, {choose(shape.services, 2)} AS service, 'entry ' || id AS message,
    CAST({uniform(3)} % {shape.users} AS VARCHAR) AS "user", {choose(shape.regions, 4)} AS region, md5(CAST(id AS VARCHAR)) AS trace
  FROM range({rows}) AS t(id)) """
