"""Consistent-hash sharding with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of hashes. A row's home is the
first point clockwise of its key's hash. A shard takes rows up to its capacity;
rows that find it full continue clockwise to the next shard with room, one
distinct shard per round. Capacities sum to the number of rows at least, so
every row is placed after at most ``shards`` rounds.

With ``slack`` 0 the capacities are the balanced ones, whose counts differ by
one at most; with slack e every shard takes up to ceil((1 + e) * rows / shards)
and fewer rows leave their home when a shard is added.

Only per-arc counts reach the driver (shards x vnodes of them, whatever the
input); rows are placed by DataFrame expressions alone.

Defined results: a null key is hashed as the text ``\\0null``; repeated rows
count each and get different slots; an empty table gives an empty result;
columns of the input are kept, and those the operator adds are named by it and
replace any of the same name.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dense import dense_positions, part_counts
from .storage import written

ADDED = ("shard", "slot", "home_shard", "hops")


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; positions are in [0, 2^63)."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            points.setdefault(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> 1, s)
    return sorted(points.items())


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def walk(points: list[tuple[int, int]], counts: dict[int, int], caps: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(arc, first, end, shard, slot of first, hops): which ranks of an arc's rows go where.

    Rows are taken by rounds: in round r every arc offers the rows it still has
    to the r-th distinct shard clockwise; arcs offer in ring order.
    """
    shards = len(caps)
    order = []
    for i in range(len(points)):
        seen: dict[int, None] = {}
        for j in range(len(points)):
            seen.setdefault(points[(i + j) % len(points)][1])
            if len(seen) == shards:
                break
        order.append(list(seen))
    used, done, out = [0] * shards, dict.fromkeys(counts, 0), []
    for hops in range(shards):
        for arc in sorted(counts):
            if hops >= len(order[arc]) or not (left := counts[arc] - done[arc]):
                continue
            s = order[arc][hops]
            if take := min(left, caps[s] - used[s]):
                out.append((arc, done[arc], done[arc] + take, s, used[s], hops))
                done[arc] += take
                used[s] += take
    return out


def arc_of(points: list[tuple[int, int]], position: int) -> int:
    """The arc that holds a position: that of the first point at or after it, round the ring."""
    return bisect_left([p for p, _ in points], position) % len(points)


def consistent_hash_shards(df: DataFrame, key: str, shards: int, vnodes: int = 128, slack: float = 0.0) -> DataFrame:
    """``df`` with shard, slot (gapless from 0 within its shard), home_shard and hops."""
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    ring = F.split(F.lit(",".join(str(p) for p, _ in points)), ",").cast("array<bigint>")
    position = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\0null"))), 1)
    steps = [1 << b for b in reversed(range(len(points).bit_length()))]
    # number of points before the position, by bisection
    below = F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: at + F.when((at + step <= len(points)) & (F.get(ring, at + step - 1) < F.col("_position")), step).otherwise(0),
    )
    kept = [c for c in df.columns if c.lower() not in ADDED]
    # the row travels as one column, so no name in it meets those that are made here
    spread = F.xxhash64(*(F.col(c) for c in kept if not dict(df.dtypes)[c].startswith("map")))
    # repeated rows spread too, by where they stand; written, so it is the same for all that reads it
    spread = spread.bitwiseXOR(F.monotonically_increasing_id())
    placed = df.select(F.struct(*kept).alias("_row"), position.alias("_position"), spread.alias("_spread"))
    placed = written(placed.withColumn("_arc", F.pmod(below, F.lit(len(points)))), "ring")
    counts = {r[0]: r[1] for r in placed.groupBy("_arc").count().collect()}
    taken = walk(points, counts, capacities(sum(counts.values()), shards, slack))
    rows = [(*t, points[t[0]][1]) for t in taken]
    plan = spark.createDataFrame(rows, "_arc int, _first long, _end long, shard int, _slot long, hops int, home_shard int")
    ranked = dense_positions(placed, "_arc", [F.col("_position"), F.col("_spread")], F.col("_spread"), part_counts(counts), "_at")
    here = (ranked["_arc"] == plan["_arc"]) & (F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))
    out = ranked.join(F.broadcast(plan), here)
    return out.select(*(F.col("_row")[c].alias(c) for c in kept), "shard", (F.col("_slot") + F.col("_at") - F.col("_first")).alias("slot"), "home_shard", "hops")
