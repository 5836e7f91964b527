"""Exact and candidate-based nearest neighbours: one scoring and top-k stage for all indexes.

Points and queries are DataFrames (id long, vec array<double>), (qid long, vec array<double>). Results are
(qid, rank, id, dist), ranks from 1 by (dist, id).
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import aligned, distance, pairwise

#: Queries of a block. One block of queries is compared with one batch of points at a time, so memory is bounded by their product.
QUERY_BLOCK, POINT_ROWS = 1024, 2048
#: Blocks of queries and batches of points that one task holds, fewer queries where there are not CELLS tasks.
TOGETHER, CELLS = 8, 48
#: From so many dimensions on, products tell which points Euclidean distances are worked out of.
PRODUCT_DIMS = 16
#: Up to so many dimensions and neighbours, many queries go by tiles instead of blocks; metrics that boxes bound.
TILED_DIMS, TILED_K, TILED_METRICS = 4, 256, ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski")
NEIGHBOURS = "qid long, id long, dist double"


def vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = POINT_ROWS) -> DataFrame:
    """fn over each task's Arrow batches, sliced to at most `rows` rows; the session's settings stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(batch.slice(k, rows) for batch in batches for k in range(0, batch.num_rows, rows))

    return df.mapInArrow(run, schema)


def check_dimensions(points: DataFrame, queries: DataFrame | None = None, column: str = "vec") -> int:
    """The one dimension of all vectors (0 without any); ValueError where there are several, or a vector is null or empty. Every search asks this first."""
    sizes = points.select(F.coalesce(F.size(column), F.lit(-1)).alias("n"))
    if queries is not None:
        sizes = sizes.union(queries.select(F.coalesce(F.size(column), F.lit(-1))))
    low, high = sizes.agg(F.min("n"), F.max("n")).first()
    if low != high or low is not None and low < 1:
        raise ValueError(f"vectors need one dimension, found {low} to {high}")
    return low or 0


class Searchable:
    """What an index can do; subclasses say more where they can."""

    #: Whether insert works, whether the index has layers, and whether its graph can carry metadata.
    mutable, layered, metadata = False, False, False
    metric = "euclidean"

    def insert(self, more: DataFrame):
        raise NotImplementedError(f"{type(self).__name__} takes no further points")

    def configured_k(self) -> int | None:
        """Neighbours of a node, where that is part of the index."""
        return None

    def edges(self) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no graph")


@dataclass
class BruteForce(Searchable):
    """All points, compared with every query."""

    points: DataFrame
    metric: str = "euclidean"
    mutable = True

    def insert(self, more: DataFrame) -> BruteForce:
        """A new index with more points (id, vec); ValueError where an id is there already, or the dimension differs."""
        check_dimensions(self.points, more)
        if not more.select("id").join(self.points.select("id"), "id", "left_semi").isEmpty() or more.count() != more.select("id").distinct().count():
            raise ValueError("an id is there already")
        return BruteForce(self.points.select("id", "vec").union(more.select("id", "vec")), self.metric)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return search(self.points, queries, k, self.metric)


def top_k(scored: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """The k nearest (dist, then id) of each query, with their rank."""
    order = Window.partitionBy(by).orderBy("dist", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(by, "rank", "id", "dist")


def block_best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, **metric) -> pa.RecordBatch:
    """The k nearest points of a batch for each query of a block."""
    i, j, dist = _block(q, qid, x, ids, k, exclude_self, np.full(len(q), np.inf), metric)
    return pa.RecordBatch.from_pydict({"qid": qid[i], "id": ids[j], "dist": dist})


def cell_best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, **metric) -> pa.RecordBatch:
    """block_best of any number of queries and points; what one batch has found bounds what the next ones are asked for."""
    found = []
    for a in range(0, len(q), QUERY_BLOCK):
        some, names = q[a : a + QUERY_BLOCK], qid[a : a + QUERY_BLOCK]
        i, j, dist, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(len(some), np.inf)
        for b in range(0, len(x), POINT_ROWS):
            further = _block(some, names, x[b : b + POINT_ROWS], ids[b : b + POINT_ROWS], k, exclude_self, reach, metric)
            i, j, dist = _first(np.concatenate([i, further[0]]), np.concatenate([j, further[1] + b]), np.concatenate([dist, further[2]]), ids, k)
            ends = np.searchsorted(i, np.arange(len(some)), "right")
            full = ends - np.searchsorted(i, np.arange(len(some))) == k
            reach[full] = dist[ends[full] - 1]
        found.append((i + a, j, dist))
    i, j, dist = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return pa.RecordBatch.from_pydict({"qid": qid[i], "id": ids[j], "dist": dist})


def _block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, exclude_self: bool, reach: np.ndarray, metric: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of x and distances of the k nearest that are within reach of q, in order."""
    k = min(k, len(ids))
    kind = metric.get("metric", "euclidean")
    long_q, long_x = (q * q).sum(axis=1), (x * x).sum(axis=1)
    if q.shape[1] >= PRODUCT_DIMS and kind in ("euclidean", "sqeuclidean") and metric.get("weights") is None and np.isfinite(long_q).all() and np.isfinite(long_x).all():
        bound = np.column_stack([-2 * q, long_q, np.ones(len(q))]) @ np.column_stack([x, np.ones(len(x)), long_x]).T
        if exclude_self:
            own = np.flatnonzero(np.isin(qid, ids))
            at, j = np.nonzero(qid[own][:, None] == ids[None, :])
            bound[own[at], j] = np.inf
        # More than both ways of adding up can differ by.
        room = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (long_q + long_x.max())
        limit = (reach**2 if kind == "euclidean" else reach) * (1 + 1e-12) + room
        open_ = np.flatnonzero(np.isinf(reach))
        if len(open_):
            limit[open_] = np.partition(bound[open_], k - 1, axis=1)[:, k - 1] + 2 * room[open_]
        i, j = np.nonzero(bound <= limit[:, None])
        dist = aligned(q[i], x[j], kind)
        keep = dist <= reach[i]
        if exclude_self:
            keep &= qid[i] != ids[j]
        i, j, dist = i[keep], j[keep], dist[keep]
    else:
        far = pairwise(q, x, **metric)
        far[np.isnan(far)] = np.inf
        if exclude_self:
            far[qid[:, None] == ids[None, :]] = np.inf
        i, j = np.nonzero(far <= np.minimum(np.partition(far, k - 1, axis=1)[:, k - 1], reach)[:, None])
        dist = far[i, j]
    i, j, dist = _first(i, j, dist, ids, k)
    keep = np.isfinite(dist)
    return i[keep], j[keep], dist[keep]


def _first(i: np.ndarray, j: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first (dist, then id of j) of each i."""
    by = np.lexsort((ids[j], dist, i))
    i, j, dist = i[by], j[by], dist[by]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], dist[keep]


def search(points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", p: float = 2.0, weights: list[float] | None = None, exclude_self: bool = False) -> DataFrame:
    """Exact k nearest neighbours of all queries among all points.

    Queries and points are dealt into blocks that meet pairwise (a stated query set against all rows, in blocks). Every pair of blocks keeps
    at most k points for each query before anything is shuffled for the final top k. With one block of queries, it is broadcast
    (at most QUERY_BLOCK vectors) and points do not move at all. In few dimensions, more queries go by tiles (tiles.py), which read only what is
    near. k <= 0 gives an empty result; vectors of several sizes raise a ValueError."""
    dims = check_dimensions(points, queries)
    if k <= 0:
        return points.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
    options = {"metric": metric, "p": p, "weights": weights}
    points, queries = points.select(F.col("id").cast("long"), "vec"), queries.select(F.col("qid").cast("long"), "vec")
    n_queries = queries.count()
    if n_queries <= QUERY_BLOCK:
        held = queries.toArrow()
        qid, q = held.column("qid").to_numpy(), vectors(held.column("vec"))
        if not len(qid):
            return points.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")

        def near(batches):
            for batch in batches:
                if batch.num_rows:
                    yield block_best(q, qid, vectors(batch.column(1)), batch.column(0).to_numpy(), k, exclude_self, **options)

        return top_k(stream(points, near, NEIGHBOURS), k)
    if dims <= TILED_DIMS and k <= TILED_K and weights is None and metric in TILED_METRICS and (metric != "minkowski" or p >= 1):
        from . import tiles

        return tiles.search(points, queries, k, dims, exclude_self, **options)
    down = max(1, -(-points.count() // (TOGETHER * POINT_ROWS)))
    across = max(-(-n_queries // (TOGETHER * QUERY_BLOCK)), min(-(-n_queries // QUERY_BLOCK), -(-CELLS // down)))
    a = queries.select("qid", "vec", F.pmod(F.xxhash64("qid"), F.lit(across).cast("long")).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("pb"))
    b = points.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("qb"))

    def meet(key, left, right):
        return pa.Table.from_batches([cell_best(vectors(left.column("vec")), left.column("qid").to_numpy(), vectors(right.column("vec")), right.column("id").to_numpy(), k, exclude_self, **options)])

    # Numbered partitions, since tasks of few bytes and many products would be run as one.
    homes = min(2 * across * down, 4000)
    return top_k(a.repartition(homes, "qb", "pb").groupBy("qb", "pb").cogroup(b.repartition(homes, "qb", "pb").groupBy("qb", "pb")).applyInArrow(meet, NEIGHBOURS), k)


def sites(points: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, vec) of each distinct vector (in groups of further columns `by`), named by its least id, and all points (site, id) of copies, the named ones too.
    The k nearest sites (dist, then id) hold the k nearest points, so that an index of sites with `expand` is one of all points."""
    named = points.groupBy(*by, "vec").agg(F.min("id").alias("id"), F.count("*").alias("_n"))
    copied = points.select(*by, "id", "vec").join(named.where("_n > 1").select(*by, "vec", F.col("id").alias("site")), [*by, "vec"]).select("site", "id")
    return named.select("id", "vec", *by), copied


def expand(found: DataFrame, copied: DataFrame, k: int) -> DataFrame:
    """The k nearest points (qid, rank, id, dist) of found sites (qid, id, dist): each site stands for its first k copies."""
    first = copied.withColumn("_r", F.row_number().over(Window.partitionBy("site").orderBy("id"))).where(F.col("_r") <= k)
    lists = first.groupBy(F.col("site").alias("id")).agg(F.collect_list(F.col("id")).alias("_ids"))
    own = found.join(lists, "id", "left").select("qid", "dist", F.explode(F.coalesce("_ids", F.array("id"))).alias("id"))
    return top_k(own.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)


def rerank(candidates: DataFrame, points: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", **options) -> DataFrame:
    """The k nearest of candidate pairs (qid, id), each scored once."""
    pairs = candidates.select("qid", "id").dropDuplicates()
    scored = pairs.join(points.select("id", F.col("vec").alias("_x")), "id").join(queries.select("qid", F.col("vec").alias("_q")), "qid")
    return top_k(scored.select("qid", "id", distance("_q", "_x", metric, **options).alias("dist")), k)


def neighbor_ids(knn: DataFrame) -> DataFrame:
    """Each query's ids in order of rank."""
    return knn.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid and recall: the share of the first k of truth that is in the first k of found; no truth gives 0."""
    t, f = (df.where(F.col("rank") <= k).select("qid", "id") for df in (truth, found))
    hit = t.join(f.withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hit.groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
