"""Trie of shared conversation prefixes: members, children, leaves and saved text per node.

A prefix is named by its depth and the exclusive or of 120-bit digests of its turns, each with
its place, so it can be built in parts: a conversation of any length is cut in ranges, and
what lies before a range is carried over. A node is then the smallest of its members and
its depth, which no other node shares.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm import tour
from shirabe.operators import skew
from shirabe.session import stored

# Ids joined in one piece before they meet in the digest of a node.
PIECE_IDS = 1 << 15
EMPTY = hashlib.sha256(b"").hexdigest()


def spelled(place: Column, digest: Column) -> list[Column]:
    """Two 60-bit halves of the digest of a turn at a place."""
    code = F.sha2(F.concat_ws(":", place.cast("string"), digest), 256)
    return [F.conv(F.substring(code, start, 15), 16, 10).cast("bigint") for start in (1, 16)]


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, chars, digest, _chunk) of every turn: its place from 1 and a digest of role and text.

    Turns are ordered by ``turn`` (null first), of one number by role and text. Null roles and texts are empty; rows
    without a conversation are left out.
    """
    rows = df.select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    placed = skew.add_row_number(skew.spread(rows, ["conv_id"], ["turn", "role", "text"]), "n").df
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    return stored(placed.select("conv_id", skew.CHUNK, "n", F.length("text").cast("bigint").alias("chars"), content.alias("digest")), "turns")


def rebuilt(turns: DataFrame, head: Column, base: Column, longest: int) -> DataFrame:
    """Rows (conv_id, depth, x, y, parent_x, parent_y, chars, ends) of conversations whose first turns are another's.

    Conversation ``c`` takes the first ``head`` turns (at most ``longest``) of conversation ``base``, both functions of
    ``conv_id``, then its own after as many. (x, y) names the prefix up to the turn. A conversation without turns has one row of depth 0.
    """
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("own")).withColumns({"head": head.cast("bigint"), "base": base})
    x, y = spelled(F.col("n"), F.col("digest"))
    upto = Window.partitionBy("conv_id").orderBy("n")  # over ``longest`` rows at most
    first = turns.where(F.col("n") <= longest).withColumns({"hx": x, "hy": y})
    first = first.withColumns({"x": F.bit_xor("hx").over(upto), "y": F.bit_xor("hy").over(upto)})
    begun = first.groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("n", "x", "y", "hx", "hy", "chars"))).alias("turns")
    )
    given = F.when(F.col("head") > 0, F.slice(F.coalesce("turns", F.array()), 1, F.greatest("head", F.lit(1)).cast("int"))).otherwise(F.slice(F.coalesce("turns", F.array()), 1, 0))
    known = convs.join(begun, "base", "left").withColumn("given", given)
    last = F.element_at("given", F.size("given"))
    zero, some = F.lit(0).cast("bigint"), F.size("given") > 0
    known = stored(
        known.select(
            "conv_id", "own", "head", "given", F.size("given").cast("bigint").alias("taken"), F.when(some, last["x"]).otherwise(zero).alias("at_x"), F.when(some, last["y"]).otherwise(zero).alias("at_y")
        ),
        "heads",
    )
    over = F.col("own") <= F.col("head")
    heads = known.select("conv_id", "taken", over.alias("over"), F.explode("given").alias("t")).select(
        "conv_id",
        F.col("t.n").alias("depth"),
        "t.x",
        "t.y",
        F.col("t.x").bitwiseXOR(F.col("t.hx")).alias("parent_x"),
        F.col("t.y").bitwiseXOR(F.col("t.hy")).alias("parent_y"),
        "t.chars",
        (F.col("over") & (F.col("t.n") == F.col("taken"))).alias("ends"),
    )
    empty = known.where(over & (F.col("taken") == 0)).select("conv_id", *[zero.alias(c) for c in ("depth", "x", "y", "parent_x", "parent_y", "chars")], F.lit(True).alias("ends"))
    place = F.col("n") - F.col("head") + F.col("taken")
    x, y = spelled(F.col("depth"), F.col("digest"))
    own = turns.join(known.drop("given"), "conv_id").where(F.col("n") > F.col("head")).withColumn("depth", place)
    own = stored(own.withColumns({"hx": x, "hy": y, "ends": F.col("n") == F.col("own")}).drop("digest", "own", "head", "taken"), "own")
    ranges = skew.Spread(own, ["conv_id"], ["n"], False)
    inside = ranges.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranges.with_rows(own.withColumns({c: F.bit_xor(f"h{c}").over(inside) for c in "xy"}))
    totals = own.groupBy("conv_id", skew.CHUNK).agg(F.bit_xor("hx").alias("tx"), F.bit_xor("hy").alias("ty"))
    before = ranges.chunk_window().rowsBetween(Window.unboundedPreceding, -1)
    carried = summed.carry(totals, F.struct(F.bit_xor("tx").over(before).alias("x"), F.bit_xor("ty").over(before).alias("y")), "_before")
    keyed = carried.withColumns({c: F.col(c).bitwiseXOR(F.coalesce(f"_before.{c}", zero)).bitwiseXOR(F.col(f"at_{c}")) for c in "xy"})
    parents = [F.col(c).bitwiseXOR(F.col(f"h{c}")).alias(f"parent_{c}") for c in "xy"]
    return heads.unionByName(keyed.select("conv_id", "depth", "x", "y", *parents, "chars", "ends")).unionByName(empty)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of nodes where conversations end: SHA-256 of their ids in rising order, joined by commas.

    Ids are range-sorted and joined in pieces first; a node's pieces then pass through its digest one by one, so
    neither step holds a node's ids at once.
    """
    keys = ["depth", "x", "y"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, at = [], None
            for key, conv in zip(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True), batch.column(3).to_pylist(), strict=True):
                if key != at or len(out[-1][1]) >= PIECE_IDS:
                    out.append((key, []))
                    at = key
                out[-1][1].append(conv)
            columns = [[key[i] for key, _ in out] for i in range(3)] + [[ids[0] for _, ids in out]]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns], pa.array([",".join(map(str, ids)) for _, ids in out], pa.string())], names=[*keys, "first", "ids"]
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in at], pa.array([held.hexdigest()])], names=[*keys, "ends_sha256"])

        for batch in batches:
            done = []
            for key, ids in zip(zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True), batch.column(4).to_pylist(), strict=True):
                if key != at:
                    if at:
                        done.append(row())
                    at, held = key, hashlib.sha256()
                else:
                    held.update(b",")
                held.update(ids.encode())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if at:
            yield row()

    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ends.select(*keys, "conv_id").repartitionByRange(ranges, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    joined = ordered.mapInArrow(pieces, "depth bigint, x bigint, y bigint, first bigint, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "depth bigint, x bigint, y bigint, ends_sha256 string")


def trie(steps: DataFrame, bound: int = tour.BOUND, stretch: int = tour.STRETCH) -> DataFrame:
    """One row per node of the trie of ``steps`` (rows as ``rebuilt`` gives them), the root included.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (over the subtree: members but one, times the code points of the node's own text), ``ends_sha256``, and the places
    ``entered`` and ``left`` of the node in the tour. Without conversations there is no node.
    """
    keys = ["depth", "x", "y"]
    steps = stored(steps, "steps")
    found = steps.where("depth > 0").groupBy(*keys).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("parent_x").alias("parent_x"), F.min("parent_y").alias("parent_y")
    )
    zero = F.lit(0).cast("bigint")
    none = F.lit(None).cast("bigint")
    all_of = steps.where((F.col("depth") <= 1)).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = all_of.select(*[zero.alias(k) for k in keys], "conv_id", "n_convs", zero.alias("chars"), none.alias("parent_x"), none.alias("parent_y"))
    found = stored(found.unionByName(root.select(*found.columns)), "nodes")
    parents = found.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("parent_x"), F.col("y").alias("parent_y"), F.col("conv_id").alias("parent_conv_id"))
    placed = found.where("depth > 0").join(parents, ["depth", "parent_x", "parent_y"]).select(*keys, "conv_id", "n_convs", "chars", "parent_conv_id")
    nodes = stored(placed.unionByName(found.where("depth = 0").select(*keys, "conv_id", "n_convs", "chars", none.alias("parent_conv_id"))), "placed")
    weight = (F.col("n_convs") - 1) * F.col("chars")
    sums = tour.subtree_sums(nodes.select(F.col("conv_id").alias("node"), "depth", F.col("parent_conv_id").alias("parent"), weight.alias("weight")), bound, stretch)
    sums = sums.withColumnsRenamed({"node": "conv_id", "subtree_weight": "saved_tokens"})
    ends = end_digests(steps.where("ends"))
    return nodes.join(sums, ["conv_id", "depth"]).join(ends, keys, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "entered", "left"
    )
