"""Exact nearest neighbours of many queries in few dimensions, by tiles of a k-d tree.

Equal vectors are one site: of its points only those of lowest id can be among the k nearest (dist, then id) of anything, so k of them
stay, and all queries of a site share one list. Points and sites of a tile meet in one task; a site whose ball crosses its tile is
asked of the further tiles too.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import pairwise
from .knn import vectors
from .nndescent import cut
from .trees import Tree, max_leaf_size, sample_of, widest_axis

#: Expected points of a tile, and of a leaf inside of it.
TILE, LEAF = 8192, 128
#: A bound of a box may be off by rounding.
SLACK = 1 + 1e-12
LISTS = "vec array<double>, near array<struct<dist: double, id: long>>, further array<long>"


def regions(tree: Tree, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest corners of the leaves of a tree split along axes; they fill the space."""
    low, high = np.full((tree.leaves, dims), -np.inf), np.full((tree.leaves, dims), np.inf)
    todo = [(0 if tree.nodes else -1, np.full(dims, -np.inf), np.full(dims, np.inf))]
    while todo:
        at, a, b = todo.pop()
        if at < 0:
            low[-at - 1], high[-at - 1] = a, b
            continue
        direction, threshold, left, right = tree.nodes[at]
        axis = int(direction.argmax())
        under, over = b.copy(), a.copy()
        under[axis] = over[axis] = threshold
        todo += [(left, a, under), (right, over, b)]
    return low, high


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray, **metric) -> np.ndarray:
    """How near a box's points can be to a query at least [query, box]."""
    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0.0)
    return pairwise(gap.reshape(-1, q.shape[1]), np.zeros((1, q.shape[1])), **metric).reshape(len(q), -1)


def nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int, **metric) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids [query, k] of the k nearest points by (dist, id); infinite where there are fewer."""
    best, who = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    if not len(x) or not len(q):
        return best, who
    by = np.argsort(ids, kind="stable")
    x, ids = x[by], ids[by]
    tree = Tree.grow(x, widest_axis, max_leaf_size(LEAF), 0)
    inner, home = tree.route(x), tree.route(q)
    order, starts = np.argsort(inner, kind="stable"), np.searchsorted(np.sort(inner), np.arange(tree.leaves + 1))
    leaves = [order[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def ask(leaf: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(rows), 1024):
            some = rows[a : a + 1024]
            for b in range(0, len(leaf), 1024):
                own = leaf[b : b + 1024]
                dist = pairwise(q[some], x[own], **metric)
                first = np.argsort(dist, axis=1, kind="stable")[:, :k]  # points are in order of id
                d, i = np.hstack([best[some], np.take_along_axis(dist, first, 1)]), np.hstack([who[some], ids[own][first]])
                take = np.lexsort((i, d), axis=-1)[:, :k]
                best[some], who[some] = np.take_along_axis(d, take, 1), np.take_along_axis(i, take, 1)

    for n in np.unique(home).tolist():
        ask(leaves[n], np.flatnonzero(home == n))
    for n, leaf in enumerate(leaves):
        if len(leaf):
            bound = box_bounds(q, x[leaf].min(axis=0)[None], x[leaf].max(axis=0)[None], **metric)[:, 0]
            ask(leaf, np.flatnonzero((home != n) & (bound <= best[:, -1] * SLACK)))
    return best, who


def _listed(asked: pa.Table, best: np.ndarray, who: np.ndarray, further: list[np.ndarray]) -> pa.Table:
    keep = np.isfinite(best)
    counts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    near = pa.StructArray.from_arrays([pa.array(best[keep], pa.float64()), pa.array(who[keep], pa.int64())], ["dist", "id"])
    others = pa.array(np.concatenate(further) if further else np.zeros(0), pa.int64())
    vec = asked.column("vec").combine_chunks()
    vec = vec if isinstance(vec, pa.Array) else pa.concat_arrays(vec.chunks) if vec.num_chunks else pa.array([], pa.list_(pa.float64()))
    return pa.table({"vec": vec, "near": pa.ListArray.from_arrays(counts(keep.sum(axis=1)), near), "further": pa.ListArray.from_arrays(counts([len(f) for f in further]), others)})


def _with_tile(df: DataFrame, tree: Tree, columns: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tree.route(vectors(batch.column(0))))], [*batch.schema.names, "tile"])

    return df.mapInArrow(run, columns + ", tile long")


def site_lists(points: DataFrame, queries: DataFrame, k: int, dims: int, **metric) -> DataFrame:
    """(vec, near): the k nearest points (dist, id) of each distinct vector of queries; vectors that are not finite have none and are near to none."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    first = points.where(finite).withColumn("_r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("_r") <= k).select("vec", "id")
    sites = queries.where(finite).select("vec").distinct()
    tiles = max(1, -(-first.count() // TILE))
    sample = sample_of(points.where(finite).dropDuplicates(["vec"]), 0) if tiles > 1 else np.zeros((0, dims))
    tree = Tree.grow(sample, widest_axis, max_leaf_size(max(1, len(sample) // tiles)), 0) if len(sample) else Tree([], 1)
    low, high = regions(tree, dims)
    held = _with_tile(first, tree, "vec array<double>, id long")

    def meet(key, left, right):
        x, q, own = vectors(left.column("vec")) if left.num_rows else np.zeros((0, dims)), vectors(right.column("vec")) if right.num_rows else np.zeros((0, dims)), key[0].as_py()
        best, who = nearest(x, left.column("id").to_numpy(), q, k, **metric)
        further = []
        for a in range(0, len(q), 256):
            near = box_bounds(q[a : a + 256], low, high, **metric) <= best[a : a + 256, -1:] * SLACK
            near[:, own] = False
            further += [np.flatnonzero(n) for n in near]
        return _listed(right, best, who, further)

    def again(key, left, right):
        x, q = vectors(left.column("vec")) if left.num_rows else np.zeros((0, dims)), vectors(right.column("vec")) if right.num_rows else np.zeros((0, dims))
        return _listed(right, *nearest(x, left.column("id").to_numpy(), q, k, **metric), [np.zeros(0, np.int64)] * len(q))

    home = cut(held.groupBy("tile").cogroup(_with_tile(sites, tree, "vec array<double>").groupBy("tile")).applyInArrow(meet, LISTS))
    inside, crossing = home.where(F.size("further") == 0).select("vec", "near"), home.where(F.size("further") > 0)
    outer = held.groupBy("tile").cogroup(crossing.select("vec", F.explode("further").alias("tile")).groupBy("tile")).applyInArrow(again, LISTS).select("vec", "near")
    merged = crossing.select("vec", "near").union(outer).groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return inside.union(cut(merged))


def search(points: DataFrame, queries: DataFrame, k: int, dims: int, exclude_self: bool = False, **metric) -> DataFrame:
    """(qid, rank, id, dist) of all queries, as knn.search."""
    near = site_lists(points.select("vec", "id"), queries, k + exclude_self, dims, **metric).select(F.col("vec").alias("_v"), "near")
    own = queries.select("qid", F.col("vec").alias("_v")).join(near, "_v")
    listed = F.filter("near", lambda s: s["id"] != F.col("qid")) if exclude_self else F.col("near")
    rows = own.select("qid", F.posexplode(F.slice(listed, 1, k)).alias("at", "n"))
    return rows.select("qid", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("id"), F.col("n.dist").alias("dist"))
