"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.common import materialise

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def virtual_nodes(shards: int, replicas: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node in ring order; positions are signed 64-bit."""

    def position(shard: int, replica: int) -> int:
        digest = hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest()
        return int.from_bytes(digest, "big", signed=True)

    return sorted((position(s, r), s) for s in range(shards) for r in range(replicas))


def capacities(rows: int, shards: int) -> list[int]:
    """Bound of each shard: the rows divided evenly, the first shards taking the remainder."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def place(counts: Sequence[int], owners: Sequence[int], bounds: Sequence[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: (arc, first rank, end rank, shard, first slot).

    Every arc first fills the shard that owns it, in ring order; what exceeds the
    bound continues clockwise to the next virtual node whose shard has room. Works
    on one count per virtual node, however many keys there are.
    """
    load, out = [0] * len(bounds), []
    left = list(counts)
    for arc, shard in enumerate(owners):
        take = min(left[arc], bounds[shard] - load[shard])
        if take:
            out.append((arc, 0, take, shard, load[shard]))
            load[shard] += take
            left[arc] -= take
    for arc in range(len(owners)):
        step = arc
        while left[arc]:
            step = (step + 1) % len(owners)
            shard = owners[step]
            take = min(left[arc], bounds[shard] - load[shard])
            if take:
                start = counts[arc] - left[arc]
                out.append((arc, start, start + take, shard, load[shard]))
                load[shard] += take
                left[arc] -= take
    return out


def shard(df: DataFrame, keys: Sequence[str], shards: int = 16, replicas: int = 64, cell_rows: int = 20_000) -> DataFrame:
    """Distinct key rows with ``shard``, ``slot`` (gapless from 0) and ``home`` (shard before overflow).

    A key lands on the ring by its 64-bit hash and belongs to the next virtual
    node clockwise. No shard takes more than its bound (rows / shards, rounded
    down or up), keys beyond it continue clockwise, so counts differ by one at most
    and only keys of full shards move. Equal rows are counted before the shuffle
    and spread again at the end. Ranks are made per cell, a slice of an arc with about
    ``cell_rows`` rows; the number of cells follows the number of rows.

    Nulls hash like any value; an empty table gives an empty result.
    """
    if shards < 1 or replicas < 1:
        raise ValueError("shards and replicas must be positive")
    spark, keys = df.sparkSession, list(keys)
    nodes = virtual_nodes(shards, replicas)
    rows = materialise(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_at", F.xxhash64(*keys)), "ring-keys"
    )
    total = rows.agg(F.sum("_n")).first()[0] or 0
    bits = min(40, max(12, math.ceil(math.log2(max(1, total / cell_rows)))))

    # Pieces of arcs, cut at virtual nodes and at cells of 2^-12 of the ring: an equi join finds the piece.
    width, pieces, low = 1 << 52, [], LOW
    for arc, at in [*enumerate(p for p, _ in nodes), (0, HIGH)]:
        while low <= at:
            high = min(at, ((low >> 52) + 1) * width - 1)
            pieces.append((low >> 52, low, high, arc))
            low = high + 1
    arcs = spark.createDataFrame(pieces, "slice long, low long, high long, arc int")
    cells = (
        rows.withColumn("slice", F.shiftright("_at", 52))
        .join(F.broadcast(arcs), "slice")
        .where("_at between low and high")
        .withColumn("cell", F.shiftright("_at", 64 - bits))
        .select(*keys, "_n", "_at", "arc", "cell")
    )
    sizes = materialise(cells.groupBy("arc", "cell").agg(F.sum("_n").alias("_size")), "ring-cells")
    counts = {r["arc"]: r["_all"] for r in sizes.groupBy("arc").agg(F.sum("_size").alias("_all")).collect()}
    owners = [s for _, s in nodes]
    plan = place([counts.get(a, 0) for a in range(len(nodes))], owners, capacities(total, shards))
    segments = spark.createDataFrame(
        [(*p, owners[p[0]]) for p in plan], "arc int, start long, end long, shard int, base long, home int"
    )

    # Cells are in ring order but for arc 0, which also holds the ring's end; any fixed order will do.
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("arc", "cell", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("arc", "cell").orderBy("_at", *keys).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        cells.withColumn("_in", F.coalesce(F.sum("_n").over(within), F.lit(0)))
        .join(starts, ["arc", "cell"])
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
        .withColumn("_rank", F.col("_before") + F.col("_in") + F.col("_copy"))
    )
    # One segment for each arc and stretch of overflow: a few per virtual node.
    return (
        ranked.join(F.broadcast(segments), "arc")
        .where("_rank >= start and _rank < end")
        .select(*keys, "shard", (F.col("base") + F.col("_rank") - F.col("start")).alias("slot"), "home")
    )


def write_shards(df: DataFrame, assigned: DataFrame, keys: Sequence[str], path: str, pieces: int = 1) -> None:
    """Write the rows of ``df`` to one folder per shard, ``pieces`` files each, in slot order."""
    on = [df[k].eqNullSafe(assigned[k]) for k in keys]
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    joined = df.join(assigned, condition).drop(*[assigned[k] for k in keys])
    (
        joined.withColumn("piece", F.col("slot") % pieces)
        .repartition("shard", "piece")
        .sortWithinPartitions("shard", "slot")
        .drop("piece")
        .write.partitionBy("shard")
        .parquet(path)
    )
