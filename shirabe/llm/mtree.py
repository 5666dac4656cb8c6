"""Exact top-k by inner product on a paged M-tree with best-first search.

Inner products become distances by one more component, sqrt(M^2 - |x|^2), M the largest norm:
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest objects have the largest products. The
root holds routing objects; what is nearest to one of them is cut by its distance to it into subtrees
of bounded size, each built in one task: nodes of several levels with routing object, covering radius
and distance to the parent's routing object, and leaf pages whose entries keep their distance to it.
A query visits the subtrees in the order of their least distance, one, then four, then sixteen more a round,
each round with the k-th best score so far; inside a subtree a priority queue does the same node by node, and the
bound falls with every page. Stored distances rule out nodes and entries before anything is computed for them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shirabe.llm.common import lean, materialise, sent

CUTS = 16  # subtrees by distance below one routing object; a larger stretch has several
FAN = 8  # children of a node
EXACT = float(1 << 106)  # product of two squared norms below which all inner products are whole doubles
LARGEST = float(1 << 62)  # squared norm from which products are no longs
FIRST, TIMES = 1, 4  # subtrees of a query's first round, and by how much a round grows


def quantised(df: DataFrame, key: str, vector: str, factor: int) -> DataFrame:
    """(id, v): floor(factor * x) of every component as a double.

    Rows whose key or vector is null, or whose vector is empty or holds null or non-finite components, take no part,
    nor do vectors with a squared norm of 2^62 or more, whose products need not fit a long. Keys are integers.
    """
    component = lambda x: F.floor(x.cast("double") * factor).cast("double")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.forall("v", finite))
        .select("id", F.transform("v", component).alias("v"))
        .where(squared("v") < LARGEST)
    )


def squared(vector: str):
    """Squared norm."""
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as a matrix; shorter vectors are filled with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Space:
    """Vectors with the additional component, and distances in it."""

    width: int
    top: float  # M^2

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the additional component."""
        rest = np.sqrt(np.maximum(self.top - (vectors**2).sum(axis=1), 0.0))
        return np.hstack([vectors, rest[:, None]])

    def away(self, own: np.ndarray | float, products: np.ndarray) -> np.ndarray:
        """Distances of queries of squared norm ``own`` to objects, from their products."""
        return np.sqrt(np.maximum(own + self.top - 2.0 * products, 0.0))

    def slack(self, own: np.ndarray | float) -> np.ndarray | float:
        """More than the rounding of the distances in a bound; a wide bound costs work, never a result."""
        return 1e-7 * math.sqrt(self.width + 1) * (np.sqrt(own) + math.sqrt(self.top)) + 1e-6


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all rows of ``b``."""
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0))


@dataclass
class Subtree:
    """Nodes of a subtree, children side by side: a node's entries are a stretch of ``order``."""

    order: np.ndarray  # entries in the order of the leaves
    begin: np.ndarray
    end: np.ndarray
    child: np.ndarray  # first child, 0 for a leaf
    children: np.ndarray
    centre: np.ndarray  # entry that is the routing object; -1 for the subtree's own
    radius: np.ndarray  # covering radius
    to_up: np.ndarray  # distance to the parent's routing object
    to_leaf: np.ndarray  # of each entry in ``order``: distance to its leaf's routing object, ascending in a leaf

    @staticmethod
    def grow(points: np.ndarray, routing: np.ndarray, page: int) -> Subtree:
        """The subtree of lifted points below ``routing``, with at most ``page`` entries in a leaf."""
        rng = np.random.default_rng(0)
        order = np.arange(len(points))
        to_leaf = between(points, routing[None, :])[:, 0]
        rows = [[0, len(points), 0, 0, -1, float(to_leaf.max(initial=0.0)), 0.0]]
        at = 0
        while at < len(rows):
            begin, end, _, _, centre, _, _ = rows[at]
            here = order[begin:end]
            if len(here) > page:
                fan = min(FAN, math.ceil(len(here) / page))
                seeds = here[np.sort(rng.permutation(len(here))[:fan])]
                far = between(points[here], points[seeds])
                owner = far.argmin(axis=1)
                if np.bincount(owner).max() == len(here):  # as good as equal: any cut is as good
                    owner = np.arange(len(here)) * len(seeds) // len(here)
                away = far[np.arange(len(here)), owner]
                sorting = np.lexsort((away, owner))
                order[begin:end], to_leaf[begin:end] = here[sorting], away[sorting]
                up = routing if centre < 0 else points[centre]
                rows[at][2] = len(rows)
                for seed, count in enumerate(np.bincount(owner, minlength=len(seeds))):
                    if count:
                        to_up = float(between(points[seeds[seed]][None, :], up[None, :])[0, 0])
                        rows.append([begin, begin + int(count), 0, 0, int(seeds[seed]), float(to_leaf[begin + count - 1]), to_up])
                        rows[at][3] += 1
                        begin += int(count)
            else:
                sorting = np.argsort(to_leaf[begin:end], kind="stable")
                order[begin:end], to_leaf[begin:end] = here[sorting], to_leaf[begin:end][sorting]
            at += 1
        columns = list(zip(*rows, strict=True))
        whole = [np.array(c, dtype=np.int64) for c in columns[:5]]
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        whole[4] = np.where(whole[4] < 0, -1, place[whole[4]])  # routing objects by their place among the leaves
        return Subtree(order, *whole, np.array(columns[5]), np.array(columns[6]), to_leaf)

    def nearest(self, entries: np.ndarray, query: np.ndarray, to_root: float, k: int, floor: float, space: Space, taken) -> tuple[list, int]:
        """([(-score, id, place)] of the k best entries not below ``floor``, number of products computed).

        ``taken(places)`` gives the ids that entries stand for, and a mask of those that take part.
        """
        own = float((query.astype(np.float64) ** 2).sum())
        slack = space.slack(own)
        reach = float(space.away(own, floor)) + slack
        found: list[tuple[int, int, int]] = []
        computed = 0
        queue = [(0.0, 0, to_root)]
        while queue:
            least, node, away = heapq.heappop(queue)
            if least > reach:
                break
            if self.child[node]:
                kids = np.arange(self.child[node], self.child[node] + self.children[node])
                kids = kids[np.abs(away - self.to_up[kids]) - self.radius[kids] <= reach]
                far = space.away(own, (entries[self.centre[kids]] @ query).astype(np.float64))
                computed += len(kids)
                for kid, d in zip(kids.tolist(), far.tolist(), strict=True):
                    bound = max(least, d - float(self.radius[kid]))
                    if bound <= reach:
                        heapq.heappush(queue, (bound, kid, d))
                continue
            begin, end = int(self.begin[node]), int(self.end[node])
            stretch = self.to_leaf[begin:end]
            lo = begin + int(np.searchsorted(stretch, away - reach, side="left"))
            hi = begin + int(np.searchsorted(stretch, away + reach, side="right"))
            score = entries[lo:hi] @ query
            computed += hi - lo
            good = np.flatnonzero(score >= floor)
            if len(good):
                ids, part = taken(lo + good)
                good, ids = good[part], ids[part]
                first = np.lexsort((ids, -score[good]))[:k]
                found = heapq.nsmallest(k, found + [(-int(score[good[f]]), int(ids[f]), lo + int(good[f])) for f in first])
                if len(found) == k:
                    floor = max(floor, float(-found[-1][0]))
                    reach = float(space.away(own, floor)) + slack
        return found, computed


ARRAYS = ("begin", "end", "child", "children", "centre", "radius", "to_up", "to_leaf")
WHOLE = ARRAYS[:5]


class MTree:
    """An M-tree over (id, v) rows, its subtrees kept as a table in the shared folder.

    Equal vectors are one entry, named by a digest of 128 bits; an entry knows the two least ids of its rows, and
    all rows are kept beside the tree, so a vector that very many rows share is neither a large group nor dropped.
    """

    def __init__(self, rows: DataFrame, page: int = 256, subtree: int = 4096, routing: int = 2048, sample: int = 8192):
        """``routing`` bounds the routing objects of the root, chosen from ``sample`` vectors at most; every row is indexed."""
        name = F.md5(F.array_join(F.transform("v", lambda x: x.cast("bigint").cast("string")), " "))
        self.rows = materialise(rows.groupBy("id", "v").agg(F.count("*").alias("n")).withColumn("name", name), "vectors")
        least = self.rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("id", "v"))).where("place <= 2")
        entries = least.groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("second"), F.first("v").alias("v"))
        entries = materialise(entries, "entries")
        count, width, top = entries.agg(F.count("*"), F.max(F.size("v")), F.max(squared("v"))).first()
        self.space = Space(width or 1, top or 0.0)
        number = max(1, min(routing, math.ceil(count / subtree)))
        share = min(1.0, sample / max(1, count))
        drawn = entries.where(F.pmod(F.xxhash64("name"), F.lit(1 << 30)) < (1 << 30) * share).orderBy(F.xxhash64("name"), "name").limit(sample)
        table = drawn.select("v").toArrow()
        seeds = matrix(table.column(0).combine_chunks(), self.space.width) if table.num_rows else np.zeros((1, self.space.width))
        self.routing = self._spread(self.space.lift(seeds), number)
        self.trees = self._built(entries, page, subtree)
        # One row per routing object and cut: at most ``routing`` * CUTS.
        directory = self.trees.groupBy("parent", "cut").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("parent", "cut").toArrow()
        self.directory = {n: directory.column(n).to_numpy() for n in ("parent", "cut", "low", "high")}

    @staticmethod
    def _spread(points: np.ndarray, number: int) -> np.ndarray:
        """Routing objects by a few rounds of nearest-centre assignment; each is an object of the sample."""
        points = np.unique(points, axis=0)
        centres = points[np.random.default_rng(0).permutation(len(points))[:number]]
        for _ in range(4):
            owner = between(points, centres).argmin(axis=1)
            filled, place = np.unique(owner, return_inverse=True)
            means = np.zeros((len(filled), points.shape[1]))
            np.add.at(means, place, points)
            means /= np.bincount(place)[:, None]
            centres = points[np.unique(between(points, means).argmin(axis=0))]
        return centres

    def _built(self, entries: DataFrame, page: int, subtree: int) -> DataFrame:
        """One row per subtree: routing object, cut, span of distances to the routing object, nodes and entries."""
        space, shared = self.space, sent(entries, self.routing)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            points = shared.value
            for batch in batches:
                lifted = space.lift(matrix(batch.column(3), space.width))
                far = [between(lifted[lo : lo + 512], points) for lo in range(0, len(lifted), 512)]
                parents = np.concatenate([f.argmin(axis=1) for f in far] or [np.zeros(0, np.int64)])
                nearest = np.concatenate([f.min(axis=1) for f in far] or [np.zeros(0)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, pa.int32()), pa.array(nearest)], names=[*batch.schema.names, "parent", "away"])

        schema = "name string, id bigint, second bigint, v array<double>, parent int, away double"
        placed = materialise(entries.select("name", "id", "second", "v").mapInArrow(lean(assign), schema), "placed")
        # Bins of the distance to the routing object, added up to cuts of about equal size; at most ``routing`` * 256 rows.
        reach = placed.groupBy("parent").agg(F.max("away").alias("reach"), F.count("*").alias("all"))
        step = F.when(F.col("reach") > 0, F.least(F.floor(F.col("away") / F.col("reach") * 256), F.lit(255))).otherwise(0).cast("int")
        binned = placed.join(F.broadcast(materialise(reach, "reach")), "parent").withColumn("bin", step)
        sizes = binned.groupBy("parent", "bin").agg(F.count("*").alias("size"), F.first("all").alias("all"))
        before = F.sum("size").over(Window.partitionBy("parent").orderBy("bin")) - F.col("size")
        wanted = F.least(F.ceil(F.col("all") / subtree), F.lit(CUTS))
        cuts = sizes.withColumn("cut", F.floor(before * wanted / F.col("all")).cast("int"))
        parts = F.ceil(F.sum("size").over(Window.partitionBy("parent", "cut")) / subtree)
        cuts = materialise(cuts.withColumn("parts", parts).select("parent", "bin", "cut", "parts"), "cuts")
        grouped = binned.join(F.broadcast(cuts), ["parent", "bin"]).withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            parent, cut, part = (int(frame[c].iat[0]) for c in ("parent", "cut", "part"))
            frame = frame.sort_values("name", ignore_index=True)
            block = np.zeros((len(frame), space.width))
            for row, values in enumerate(frame["v"]):
                block[row, : len(values)] = values
            tree = Subtree.grow(space.lift(block), shared.value[parent], page)
            frame = frame.iloc[tree.order]
            made = {"parent": parent, "cut": cut, "part": part, "low": frame["away"].min(), "high": frame["away"].max()}
            made |= {"names": "".join(frame["name"]), "ids": frame["id"].to_numpy(np.int64).tobytes(), "seconds": frame["second"].to_numpy(np.int64).tobytes()}
            made |= {"entries": block[tree.order].astype(np.int64).tobytes()} | {a: getattr(tree, a).tobytes() for a in ARRAYS}
            return pd.DataFrame([made])

        schema = "parent int, cut int, part int, low double, high double, names string, ids binary, seconds binary, entries binary, "
        schema += ", ".join(f"`{a}` binary" for a in ARRAYS)
        columns = ["name", "id", "second", "v", "away", "parent", "cut", "part"]
        return materialise(grouped.select(columns).groupBy("parent", "cut", "part").applyInPandas(build, schema), "trees")

    def _asking(self, queries: DataFrame, start: int, stop: int, block: int = 64) -> DataFrame:
        """(parent, cut, queries of a block): who visits which subtrees, the ``start``-th to ``stop``-th nearest of each query
        as far as their bound can still beat the query's k-th best score."""
        space, shared = self.space, sent(queries, (self.routing, self.directory))
        fields = pa.schema([("parent", pa.int32()), ("cut", pa.int32()), *((n, pa.binary()) for n in ("query_ids", "queries", "floors", "aways"))])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            routing, spans = shared.value
            for batch in batches:
                wanted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                vectors = matrix(batch.column(1), space.width)
                ids, floors = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                for lo in range(0, len(ids), block):
                    part = vectors[lo : lo + block]
                    own = (part**2).sum(axis=1)
                    far = space.away(own[:, None], part @ routing[:, :-1].T)[:, spans["parent"]]
                    least = np.maximum(0.0, np.maximum(far - spans["high"], spans["low"] - far))
                    reach = space.away(own, floors[lo : lo + block]) + space.slack(own)
                    # The nearest first; of subtrees that a query may lie in, the one with the nearest routing object.
                    order = np.lexsort((np.broadcast_to(np.arange(least.shape[1]), least.shape), far, least), axis=1)[:, start:stop]
                    row, place = np.nonzero(np.take_along_axis(least, order, axis=1) <= reach[:, None])
                    wanted.append((row + lo, order[row, place], far[row, order[row, place]]))
                rows, spots, aways = (np.concatenate(c) for c in zip(*wanted, strict=True)) if wanted else (np.zeros(0, int),) * 3
                sorting = np.argsort(spots, kind="stable")
                rows, spots, aways = rows[sorting], spots[sorting], aways[sorting]
                found, begins = np.unique(spots, return_index=True)
                for spot, mine, to_root in zip(found, np.split(rows, begins[1:]), np.split(aways, begins[1:]), strict=False):
                    made = {"parent": int(spans["parent"][spot]), "cut": int(spans["cut"][spot]), "aways": to_root.tobytes()}
                    made |= {"query_ids": ids[mine].tobytes(), "queries": vectors[mine].astype(np.int64).tobytes(), "floors": floors[mine].tobytes()}
                    yield pa.RecordBatch.from_pylist([made], schema=fields)

        schema = "parent int, cut int, query_ids binary, queries binary, floors binary, aways binary"
        return queries.select("id", "v", F.col("floor").cast("double")).mapInArrow(lean(ask), schema)

    def _visit(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, name, vec_id, score): the k best entries of every visited subtree, vec_id the least id that is not the query's;
        and one row per query and subtree without name whose score is the number of products computed."""
        space = self.space

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    row = batch.slice(at, 1).to_pylist()[0]
                    nodes = {a: np.frombuffer(row[a], np.int64 if a in WHOLE else np.float64) for a in ARRAYS}
                    ids, seconds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["seconds"], np.int64)
                    entries = np.frombuffer(row["entries"], np.int64).reshape(len(ids), space.width)
                    tree = Subtree(np.arange(len(ids)), **nodes)
                    asking = np.frombuffer(row["query_ids"], np.int64)
                    queries = np.frombuffer(row["queries"], np.int64).reshape(len(asking), space.width)
                    floors, aways = np.frombuffer(row["floors"]), np.frombuffer(row["aways"])
                    norm = (queries.astype(np.float64) ** 2).sum(axis=1).max()
                    if norm * space.top < EXACT:  # no product nor part of its sum is rounded, and doubles are multiplied faster
                        entries, queries = entries.astype(np.float64), queries.astype(np.float64)
                    made: list[tuple] = []
                    for q, mine in enumerate(asking.tolist()):

                        def taken(places: np.ndarray, mine: int = mine) -> tuple[np.ndarray, np.ndarray]:
                            least = np.where(ids[places] == mine, seconds[places], ids[places])
                            return least, least != mine

                        best_here, computed = tree.nearest(entries, queries[q], float(aways[q]), k, float(floors[q]), space, taken)
                        made.append((mine, None, None, computed))
                        made += [(mine, row["names"][32 * place : 32 * place + 32], other, -score) for score, other, place in best_here]
                    columns = list(zip(*made, strict=True))
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "name", "vec_id", "score"])

        return asked.join(self.trees, ["parent", "cut"]).mapInArrow(lean(search), "query_id bigint, name string, vec_id bigint, score bigint")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, rank, vec_id, score): the k largest inner products of each query (id, v), its own id left out, ties to the smaller id.

        ``self.computed`` then holds (query_id, computed): products computed below the root.
        """
        lowest = float(-(1 << 62))
        queries = materialise(queries.select("id", "v"), "queries")
        found, work, start, more = None, None, 0, FIRST
        while start < len(self.directory["parent"]):
            known = queries.withColumn("floor", F.lit(lowest))
            if found is not None:
                floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
                known = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(lowest)))
            got = materialise(self._visit(self._asking(known, start, start + more), k), "visited")
            if got.isEmpty():
                break
            work = got.where("name is null") if work is None else work.union(got.where("name is null"))
            new = got.where("name is not null")
            found = materialise(best(new if found is None else found.drop("rank").union(new), k), "found")
            start, more = start + more, more * TIMES
        if found is None:
            found = queries.select(F.col("id").alias("query_id"), F.lit("").alias("name"), F.col("id").alias("vec_id"), F.col("id").alias("score")).limit(0)
            work = found
        self.computed = work.groupBy("query_id").agg(F.sum("score").alias("computed"))
        # The rows of the entries found: k + 1 ids of an entry and k copies of a row are all that k places can need.
        rows = self.rows.join(found.select("name").distinct(), "name", "semi")
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("id", "v"))).where(F.col("place") <= k + 1)
        rows = rows.select("name", F.col("id").alias("vec_id"), F.least("n", F.lit(k)).cast("int").alias("n"))
        pairs = found.select("query_id", "name", "score").join(rows, "name").where("query_id <> vec_id")
        pairs = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), "n")))
        return best(pairs, k).select("query_id", "rank", "vec_id", "score")


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query; Spark keeps k per task before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = [c for c in ("query_id", "name", "vec_id", "score") if c in found.columns]
    return found.select(kept).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, key: str, vector: str, every: int, k: int, factor: int = 256) -> DataFrame:
    """Exact neighbours of the rows whose key is divisible by ``every``, among all rows.

    Components are floor(factor * x). Vectors of different lengths are filled with zeros. Repeated keys are one query,
    asked with the least of their vectors; as candidates all rows count, copies too.
    """
    tree = MTree(quantised(df, key, vector, factor))
    queries = tree.rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    return tree.search(queries, k)
