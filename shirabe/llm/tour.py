"""Sums over subtrees by an Euler tour: arcs, distributed list ranking, prefix sums.

Every node gives an arc that enters it and one that leaves it. Each arc knows its
successor: an entering arc goes to the first child or, at a leaf, to its own leaving arc;
a leaving arc goes to the next sibling or else leaves the parent. The list of arcs is
ranked by contraction:

1. Arcs are range-sorted by (node, depth). In each stretch of a range chains of arcs
   that follow one another are contracted to one link, with numpy.
2. While more than ``bound`` links are left, random mates are joined: a link of coin 0
   takes in its successor of coin 1, about a quarter of all links a round.
3. The ``bound`` links at most that are left are ranked in one task, and the ranks
   go back to the links taken in, round by round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shirabe.operators import skew
from shirabe.session import stored

# Arcs contracted at once by one task.
STRETCH = 1 << 19
# Links that one task may rank at the end.
BOUND = 1 << 16
WEIGHTS = ["rank", "leaves", "weight"]


def followers(a: np.ndarray, b: np.ndarray, next_a: np.ndarray, next_b: np.ndarray) -> np.ndarray:
    """Index of the row each row's successor is in, -1 where it is elsewhere; ids are pairs (a, b) with b of 0 or more."""
    known, width = np.unique(a), int(b.max(initial=0)) + 1
    keys = np.searchsorted(known, a) * width + b
    order = np.argsort(keys)
    near = np.minimum(np.searchsorted(known, next_a), len(known) - 1)
    wanted = np.where((known[near] == next_a) & (next_b >= 0) & (next_b < width), near * width + next_b, -1)
    spot = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][spot] == wanted, order[spot], -1)


def ranked(follower: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of its chain, weights before it) of every row, by pointer jumping over predecessors."""
    n = len(follower)
    before, inside = np.arange(n), np.flatnonzero(follower >= 0)
    before[follower[inside]] = inside
    held = np.where((before == np.arange(n))[:, None], 0, weights[before])
    while True:
        further = before[before]
        if np.array_equal(further, before):
            return before, held
        held = held + held[before]
        before = further


def gathered(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.Table]:
    """Batches joined to tables of at least ``limit`` rows; all in one without a limit."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if limit and rows >= limit:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def arrays(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


LINK = ["a", "b", "next_a", "next_b", *WEIGHTS]


def _contract(arcs: DataFrame, stretch: int) -> DataFrame:
    """Every arc with the head of its chain and its place there; a chain's last arc also has the link it becomes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, stretch):
            a, b, next_a, next_b, *rest = arrays(table, LINK)
            weights, follower = np.stack(rest, axis=1), followers(a, b, next_a, next_b)
            head, held = ranked(follower, weights)
            total = held + weights
            values = [a, b, a[head], b[head], *held.T, next_a, next_b, *total.T]
            names = ["a", "b", "head_a", "head_b", *[f"off_{w}" for w in WEIGHTS], "next_a", "next_b", *[f"sum_{w}" for w in WEIGHTS]]
            yield pa.RecordBatch.from_arrays([*[pa.array(v) for v in values], pa.array(follower < 0)], names=[*names, "last"])

    names = ["a", "b", "head_a", "head_b", *[f"off_{w}" for w in WEIGHTS], "next_a", "next_b", *[f"sum_{w}" for w in WEIGHTS]]
    return arcs.select(*LINK).mapInArrow(run, ", ".join(f"{c} bigint" for c in names) + ", last boolean")


def _finish(links: DataFrame) -> DataFrame:
    """Weights before each of a bounded number of links, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, None):
            a, b, next_a, next_b, *rest = arrays(table, LINK)
            _, held = ranked(followers(a, b, next_a, next_b), np.stack(rest, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, *held.T)], names=["a", "b", *WEIGHTS])

    return links.select(*LINK).repartition(1).mapInArrow(run, ", ".join(f"{c} bigint" for c in ["a", "b", *WEIGHTS]))


def rank_list(arcs: DataFrame, bound: int = BOUND, stretch: int = STRETCH) -> DataFrame:
    """(a, b, rank, leaves, weight): what lies before each arc of one list.

    ``arcs`` has ids (a, b), successors (next_a, next_b), with next_b -1 at the end, and the weights.
    """
    ranges = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = stored(_contract(arcs.repartitionByRange(ranges, "a", "b").sortWithinPartitions("a", "b"), stretch), "chains")
    sums = [F.col(f"sum_{w}").alias(w) for w in WEIGHTS]
    links = members.where("last").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"), "next_a", "next_b", *sums)
    taken: list[DataFrame] = []
    while links.count() > bound:
        coin = F.xxhash64("a", "b", F.lit(len(taken))) % 2 == 0
        left = links.where(coin).select(F.struct(*LINK).alias("l"))
        right = links.where(~coin).select(F.struct(*LINK).alias("r"))
        mates = stored(left.join(right, (F.col("l.next_a") == F.col("r.a")) & (F.col("l.next_b") == F.col("r.b")), "full"), "mates")
        alone, first = F.col("l").isNull(), F.col("r").isNull()
        pick = lambda c, own, both: F.when(alone, F.col(f"r.{c}")).when(first, F.col(f"l.{c}")).otherwise(own if both is None else both).alias(c)
        links = mates.select(
            *[pick(c, F.col(f"l.{c}"), None) for c in ("a", "b")],
            *[pick(c, F.col(f"r.{c}"), None) for c in ("next_a", "next_b")],
            *[pick(c, None, F.col(f"l.{c}") + F.col(f"r.{c}")) for c in WEIGHTS],
        )
        taken.append(mates.where(~alone & ~first).select("r.a", "r.b", F.col("l.a").alias("to_a"), F.col("l.b").alias("to_b"), *[F.col(f"l.{c}").alias(f"off_{c}") for c in WEIGHTS]))
    placed = stored(_finish(links), "ranks")
    for absorbed in reversed(taken):
        to = placed.select(F.col("a").alias("to_a"), F.col("b").alias("to_b"), *WEIGHTS)
        moved = absorbed.join(to, ["to_a", "to_b"]).select("a", "b", *[(F.col(c) + F.col(f"off_{c}")).alias(c) for c in WEIGHTS])
        placed = stored(placed.unionByName(moved), "ranks")
    heads = placed.select(F.col("a").alias("head_a"), F.col("b").alias("head_b"), *WEIGHTS)
    return members.join(heads, ["head_a", "head_b"]).select("a", "b", *[(F.col(c) + F.col(f"off_{c}")).alias(c) for c in WEIGHTS])


def subtree_sums(nodes: DataFrame, bound: int = BOUND, stretch: int = STRETCH) -> DataFrame:
    """(node, depth, n_children, entered, left, n_leaves, subtree_weight) of every node of one tree.

    ``nodes`` has ``node``, ``depth``, ``parent`` and ``weight``: (node, depth) names a node, (parent, depth - 1) its
    parent, and only the root has a null parent. ``entered`` and ``left`` are places in the tour. Children follow in the order of
    ``node``; a parent with very many is split over ranges.
    """
    below = nodes.where(F.col("parent").isNotNull())
    siblings = skew.spread(below.select("parent", "depth", "node"), ["parent", "depth"], ["node"], descending=True)
    following = skew.add_lag(siblings, "node", "sibling").rows().select("node", "depth", "sibling")
    children = below.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("node").alias("child"))
    known = stored(nodes.join(following, ["node", "depth"], "left").join(children, ["node", "depth"], "left").na.fill(0, ["n_children"]), "tree")
    leaf, depth = F.col("n_children") == 0, F.col("depth")
    none = F.lit(None).cast("bigint")
    enter = F.struct(
        F.col("node").alias("a"),
        (2 * depth).alias("b"),
        F.when(leaf, F.col("node")).otherwise(F.col("child")).alias("next_a"),
        F.when(leaf, 2 * depth + 1).otherwise(2 * depth + 2).alias("next_b"),
        F.lit(1).cast("bigint").alias("rank"),
        leaf.cast("bigint").alias("leaves"),
        F.col("weight").alias("weight"),
    )
    root = F.col("parent").isNull()
    leave = F.struct(
        F.col("node").alias("a"),
        (2 * depth + 1).alias("b"),
        F.when(root, F.lit(0)).otherwise(F.coalesce("sibling", "parent")).alias("next_a"),
        F.when(root, F.lit(-1)).when(F.col("sibling").isNotNull(), 2 * depth).otherwise(2 * depth - 1).alias("next_b"),
        F.lit(1).cast("bigint").alias("rank"),
        F.coalesce(none, F.lit(0)).alias("leaves"),
        F.coalesce(none, F.lit(0)).alias("weight"),
    )
    arcs = known.select(F.explode(F.array(enter, leave)).alias("e")).select("e.*")
    places = rank_list(arcs, bound, stretch)
    spans = places.groupBy(F.col("a").alias("node"), F.floor(F.col("b") / 2).alias("depth")).agg(
        F.min("rank").alias("entered"),
        F.max("rank").alias("left"),
        (F.max("leaves") - F.min("leaves")).alias("n_leaves"),
        (F.max("weight") - F.min("weight")).alias("subtree_weight"),
    )
    return known.select("node", "depth", "n_children").join(spans, ["node", "depth"])
