"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Write ``df`` as a table in the shared scratch folder and read it again: a lost executor repeats only later steps.
from shirabe.session import stored as materialise

__all__ = ["components", "give_back", "lean", "materialise", "release", "sent", "unused"]


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case of its names."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def give_back() -> None:
    """Return the memory of finished arrays to the system; a reused Python worker would keep its largest size for ever."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving its memory back at the end of the task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


_sent: list[Broadcast] = []


def sent(df: DataFrame, value: object) -> Broadcast:
    """Broadcast a value of a bounded size; ``release`` drops it from the executors."""
    _sent.append(df.sparkSession.sparkContext.broadcast(value))
    return _sent[-1]


def release() -> None:
    """Drop what earlier steps have broadcast from the executors; a task that still needs it fetches it again."""
    while _sent:
        try:
            _sent.pop().unpersist()
        except Py4JError:  # of a session that has ended
            pass


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    made = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), "edges")
    return made, (seen.get["n"], seen.get["total"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the pairs ``(a, b)``: one row (node, root) per node that is not its root.

    Large-star and small-star steps: each node links its larger neighbours, then
    itself and its smaller ones, to the least of them, until only stars are left.
    The least of a node's neighbours is aggregated before the shuffle and joined
    back, so a node with very many neighbours is split by the skew join.
    """
    edges, before = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges, after = _kept(small.select("e.a", "e.b").where("a <> b").distinct())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
