"""Gapless positions within groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_ROWS = 500_000
BROADCAST_PARTS = 1_000_000


def part_counts(counts: dict[int, int], part_rows: int = PART_ROWS) -> dict[int, int]:
    """Into how many parts each group is dealt, from its rows."""
    return {g: -(-n // part_rows) for g, n in counts.items()}


def dense_positions(df: DataFrame, group: str, order: list[Column], spread: Column, parts: dict[int, int], name: str) -> DataFrame:
    """Add ``name``: a position from 0 without gaps within each ``group`` (a small whole number).

    A group is dealt over as many ``parts`` as its rows ask for, by ``spread``;
    each part is numbered by itself and starts where the parts before it end,
    so a group that holds a third of all rows is numbered by many tasks. The
    table of part sizes has a row for each part and is broadcast up to
    ``BROADCAST_PARTS`` of them. ``df`` must be stable (a written table), for it
    is read twice.
    """
    last = max(parts, default=0)
    of_group = F.split(F.lit(",".join(str(parts.get(g, 1)) for g in range(last + 1))), ",").cast("array<int>")
    salted = df.withColumn("_part", F.pmod(spread, F.coalesce(F.get(of_group, F.col(group).cast("int")), F.lit(1))))
    sizes = salted.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = salted.withColumn("_rank", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)))
    starts = F.broadcast(starts) if sum(parts.values()) <= BROADCAST_PARTS else starts
    return ranked.join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_rank") - 1).drop("_part", "_start", "_rank")
