"""Binary partition trees: k-d, random-projection and principal-component trees and forests.

A tree is built on the driver from a hashed sample of bounded size and broadcast; all points are then routed to its leaves, and
queries meet them in their common leaf. A k-d search is exact: the home leaf gives a radius, and all leaves whose box
may hold something nearer are read next.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import pairwise
from .knn import Searchable, block_best, check_dimensions, search, stream, top_k, vectors

#: Points that trees are built from.
SAMPLE = 32_768
#: Points of a leaf that one task holds.
LEAF_ROWS = 65_536
#: Queries that the recall of a forest is measured on.
SAMPLED = 64
Splitter = Callable[[np.ndarray, np.random.Generator, int], "tuple[np.ndarray, float] | None"]


def rng_for(seed: int, *path: int) -> np.random.Generator:
    """Draws that depend on the seed and a place only, not on scheduling."""
    return np.random.default_rng([seed, *path])


@dataclass
class Tree:
    """Inner nodes (direction, threshold, left, right); children below zero are leaves -1, -2, ... A point goes right if its projection is greater."""

    nodes: list[tuple[np.ndarray, float, int, int]]
    leaves: int

    @classmethod
    def grow(cls, x: np.ndarray, split: Splitter, stop: Callable[[np.ndarray], bool], seed: int) -> Tree:
        nodes: list = []
        leaves = 0
        todo = [(x, None, 0, 1)]
        while todo:
            own, parent, side, place = todo.pop()
            found = None if stop(own) else split(own, rng_for(seed, place % (1 << 31)), place.bit_length() - 1)
            right = None if found is None else own @ found[0] > found[1]
            if right is None or right.all() or not right.any():
                leaves += 1
                at = -leaves
            else:
                at = len(nodes)
                nodes.append([found[0], found[1], None, None])
                todo += [(own[~right], at, 2, 2 * place), (own[right], at, 3, 2 * place + 1)]
            if parent is not None:
                nodes[parent][side] = at
        return cls([tuple(n) for n in nodes], leaves)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf numbers from 0."""
        out = np.zeros(len(x), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -at - 1
            elif len(rows):
                direction, threshold, left, right = self.nodes[at]
                far = x[rows] @ direction > threshold
                todo += [(left, rows[~far]), (right, rows[far])]
        return out

    def route_near(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The numbers [row, probe] of the leaves with the least sum of squared distances to the planes that lie between."""
        cost = np.zeros((len(x), self.leaves))
        todo = [(0 if self.nodes else -1, np.zeros(len(x)))]
        while todo:
            at, c = todo.pop()
            if at < 0:
                cost[:, -at - 1] = c
                continue
            direction, threshold, left, right = self.nodes[at]
            margin = (x @ direction - threshold) / (np.linalg.norm(direction) or 1.0)
            todo += [(left, c + np.maximum(margin, 0) ** 2), (right, c + np.minimum(margin, 0) ** 2)]
        return np.argsort(cost, axis=1, kind="stable")[:, :probes]


# Splitters and what they are made of.


def widest_axis(x: np.ndarray, draws, depth: int):
    """k-d split at the median of the axis of greatest spread."""
    axis = int(np.ptp(x, axis=0).argmax())
    return _axis_split(x, axis)


def cyclic_axis(x: np.ndarray, draws, depth: int):
    return _axis_split(x, depth % x.shape[1])


def _axis_split(x: np.ndarray, axis: int):
    values = np.sort(x[:, axis])
    if values[0] == values[-1]:
        return None
    at = values[(len(values) - 1) // 2]
    return np.eye(x.shape[1])[axis], float(at if at < values[-1] else values[values < at][-1])


def two_points(x: np.ndarray, draws: np.random.Generator, depth: int):
    """The plane halfway between two random points; None for equal points."""
    a, b = x[draws.choice(len(x), 2, replace=False)]
    return None if np.array_equal(a, b) else (b - a, float((b - a) @ (a + b) / 2))


def exact_spectrum(x: np.ndarray, draws) -> tuple[np.ndarray, np.ndarray]:
    _, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return s**2, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])[:, None]


def randomized_spectrum(rank: int, oversample: int = 10, rounds: int = 2):
    def run(x: np.ndarray, draws: np.random.Generator):
        c = x - x.mean(axis=0)
        q = np.linalg.qr(c @ draws.standard_normal((c.shape[1], min(rank + oversample, *c.shape))))[0]
        for _ in range(rounds):
            q = np.linalg.qr(c @ np.linalg.qr(c.T @ q)[0])[0]
        _, s, v = np.linalg.svd(q.T @ c, full_matrices=False)
        return s[:rank] ** 2, v[:rank]

    return run


def subsampled_spectrum(rows: int):
    return lambda x, draws: exact_spectrum(x[draws.choice(len(x), min(rows, len(x)), replace=False)], draws)


def top_component(values, axes, draws):
    return axes[0]


def random_top(k: int):
    return lambda values, axes, draws: axes[int(draws.integers(min(k, len(axes))))]


def random_combination(k: int):
    def run(values, axes, draws):
        w = draws.standard_normal(min(k, len(axes))) * np.sqrt(values[: min(k, len(axes))])
        v = w @ axes[: len(w)]
        return v / (np.linalg.norm(v) or 1.0)

    return run


def median_value(projected, draws):
    return float(np.median(projected))


def mean_value(projected, draws):
    return float(projected.mean())


def between_quantiles(low: float = 0.4, high: float = 0.6):
    def run(projected, draws):
        values = np.sort(projected)
        a, b = round(low * (len(values) - 1)), round(high * (len(values) - 1))
        return float(draws.uniform(values[a], values[b])) if values[a] < values[b] else float(values[a])

    return run


def pca_splitter(spectrum=exact_spectrum, direction=top_component, value=median_value) -> Splitter:
    def split(x, draws, depth):
        values, axes = spectrum(x, draws)
        if not len(values) or values[0] <= 1e-18:
            return None
        v = direction(values, axes, draws)
        return v, value(x @ v, draws)

    return split


def pca_forest_splitter() -> Splitter:
    """The randomised preset of forests."""
    return pca_splitter(direction=random_combination(3), value=between_quantiles())


def max_leaf_size(n: int = 32):
    return lambda x: len(x) <= n


def intrinsic_dim_ratio(ratio: float = 0.1, floor: int = 256, variance: float = 0.95):
    """Stop where few axes hold nearly all variance; never above `floor` points."""

    def run(x):
        if len(x) <= floor:
            values, _ = exact_spectrum(x, None)
            total = values.sum()
            return total <= 0 or (np.searchsorted(np.cumsum(values) / total, variance) + 1) / x.shape[1] <= ratio
        return False

    return run


def any_of(*rules):
    return lambda x: any(r(x) for r in rules)


def all_of(*rules):
    """True where all hold; without rules false."""
    return lambda x: bool(rules) and all(r(x) for r in rules)


def sample_of(points: DataFrame, seed: int, limit: int = SAMPLE) -> np.ndarray:
    return vectors(points.select("id", "vec").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit).toArrow().column("vec"))


def leaf_table(df: DataFrame, trees: list[Tree], key: str) -> DataFrame:
    """(key, vec, tree, leaf) for every row and tree."""

    def run(batches):
        for batch in batches:
            x = vectors(batch.column(1))
            if len(x):
                again = pa.Table.from_batches([batch] * len(trees)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.repeat(np.arange(len(trees), dtype=np.int32), len(x))), pa.array(np.concatenate([t.route(x) for t in trees]))], [*batch.schema.names, "tree", "leaf"])

    return stream(df.select(key, "vec"), run, f"{key} long, vec array<double>, tree int, leaf long")


def probe_table(df: DataFrame, trees: list[Tree], key: str, probes: int) -> DataFrame:
    """(key, vec, tree, leaf) for every row, tree and each of its `probes` nearest leaves."""

    def run(batches):
        for batch in batches:
            x = vectors(batch.column(1))
            for number, tree in enumerate(trees if len(x) else []):
                near = tree.route_near(x, probes)
                again = batch.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(np.full(near.size, number, np.int32)), pa.array(near.ravel())], [*batch.schema.names, "tree", "leaf"])

    return stream(df.select(key, "vec"), run, f"{key} long, vec array<double>, tree int, leaf long", rows=1024)


def search_leaves(leaves: DataFrame, asked: DataFrame, k: int, metric: dict, grow: Callable[[np.ndarray, int], Tree] | None = None, exclude_self: bool = False) -> DataFrame:
    """The k nearest (qid, rank, id, dist) of queries (qid, vec, tree, leaf) among the points (id, vec, tree, leaf) of their leaves.

    A leaf's points and queries meet in one task and only the k best of each query leave it. Trees come from a sample, so leaves grow with the table: leaves of more than
    LEAF_ROWS points are dealt into parts by hash, and the queries go to all parts. Where `grow` is given, it splits a part's points again, in the
    task, and queries meet what shares their inner leaf."""
    sizes = leaves.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / LEAF_ROWS).alias("parts"))
    # A row for each leaf of the trees; their number is bounded by the sample.
    parts = F.broadcast(sizes)
    left = leaves.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("tree", "leaf", "part", "id", "vec")
    right = asked.join(parts, ["tree", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select("tree", "leaf", "part", "qid", "vec")

    def meet(key, points, queries):
        x, ids, q, qid = vectors(points.column("vec")), points.column("id").to_numpy(), vectors(queries.column("vec")), queries.column("qid").to_numpy()
        found = []
        if len(x) and len(q):
            by = np.argsort(ids, kind="stable")  # so that a lost part grows the same tree again
            x, ids = x[by], ids[by]
            tree = None if grow is None else grow(x, key[0].as_py())
            inner, wanted = (np.zeros(len(x), int), np.zeros(len(q), int)) if tree is None else (tree.route(x), tree.route(q))
            for n in np.unique(wanted).tolist():
                own, asks = np.flatnonzero(inner == n), np.flatnonzero(wanted == n)
                for a in range(0, len(asks) if len(own) else 0, 1024):
                    some = asks[a : a + 1024]
                    found += [block_best(q[some], qid[some], x[own[b : b + 2048]], ids[own[b : b + 2048]], k, exclude_self, **metric) for b in range(0, len(own), 2048)]
        return pa.Table.from_batches(found) if found else pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})

    met = left.groupBy("tree", "leaf", "part").cogroup(right.groupBy("tree", "leaf", "part")).applyInArrow(meet, "qid long, id long, dist double")
    return top_k(met.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)


@dataclass
class Forest(Searchable):
    """Trees grown from a sample; leaves that hold more than `leaf_size` points, as they do in large tables, are split on by the same rule when they are searched."""

    trees: list[Tree]
    points: DataFrame
    leaves: DataFrame
    splitter: Splitter
    stop: Callable[[np.ndarray], bool]
    seed: int
    metric: str = "euclidean"

    @classmethod
    def build(cls, points: DataFrame, splitter: Splitter = two_points, stop=None, n_trees: int = 8, seed: int = 0, metric: str = "euclidean") -> Forest:
        check_dimensions(points)
        x, stop = sample_of(points, seed), stop or max_leaf_size()
        trees = [Tree.grow(x, splitter, stop, seed + 1000 * t) for t in range(n_trees)]
        return cls(trees, points, leaf_table(points, trees, "id"), splitter, stop, seed, metric)

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False, recall: float | None = 0.95) -> DataFrame:
        """Each query reads its leaf of every tree. With a recall, SAMPLED of the queries are compared with brute force first, and the leaves that are read
        are doubled until they reach it; with all leaves the search is exact."""
        check_dimensions(self.points, queries)
        probes, most = 1, max(t.leaves for t in self.trees)
        if recall is not None and k > 0 and most > 1:
            some = queries.orderBy(F.xxhash64("qid", F.lit(self.seed)), "qid").limit(SAMPLED).toArrow().to_pylist()
            tried = self.points.sparkSession.createDataFrame([(r["qid"], r["vec"]) for r in some], "qid long, vec array<double>")
            truth = {(r["qid"], r["id"]) for r in search(self.points, tried, k, self.metric, exclude_self=exclude_self).collect()}
            while probes < most and len(truth & {(r["qid"], r["id"]) for r in self._read(tried, k, exclude_self, probes).collect()}) < recall * len(truth):
                probes *= 2
        return self._read(queries, k, exclude_self, probes)

    def _read(self, queries: DataFrame, k: int, exclude_self: bool, probes: int) -> DataFrame:
        if probes > 1:
            return search_leaves(self.leaves, probe_table(queries, self.trees, "qid", probes), k, {"metric": self.metric}, exclude_self=exclude_self)
        splitter, stop, seed = self.splitter, self.stop, self.seed

        def grow(x: np.ndarray, tree: int) -> Tree | None:
            return None if stop(x) else Tree.grow(x, splitter, stop, seed + 1000 * tree + 1)

        return search_leaves(self.leaves, leaf_table(queries, self.trees, "qid"), k, {"metric": self.metric}, grow, exclude_self)


SAFE_METRICS = ("euclidean", "sqeuclidean", "cityblock", "chebyshev", "minkowski")


@dataclass
class KdTree(Searchable):
    tree: Tree
    points: DataFrame
    leaves: DataFrame
    low: np.ndarray
    high: np.ndarray
    metric: dict

    @classmethod
    def build(cls, points: DataFrame, axis: str = "spread", leaf_size: int = 64, metric: str = "euclidean", p: float = 2.0, weights: list[float] | None = None) -> KdTree:
        if metric not in SAFE_METRICS:
            raise ValueError(f"boxes give no bound for {metric}")
        dims = check_dimensions(points)
        tree = Tree.grow(sample_of(points, 0), widest_axis if axis == "spread" else cyclic_axis, max_leaf_size(leaf_size), 0)
        leaves = leaf_table(points, [tree], "id")
        low, high = np.full((tree.leaves, dims), np.inf), np.full((tree.leaves, dims), -np.inf)
        for r in leaves.groupBy("leaf").agg(*[f(F.col("vec")[j]).alias(f"{n}{j}") for j in range(dims) for n, f in (("a", F.min), ("b", F.max))]).collect():
            low[r["leaf"]], high[r["leaf"]] = [r[f"a{j}"] for j in range(dims)], [r[f"b{j}"] for j in range(dims)]
        return cls(tree, points, leaves, low, high, {"metric": metric, "p": p, "weights": weights})

    def search(self, queries: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
        """Exact: the home leaf's k-th distance bounds what other leaves can add; every leaf whose box is not farther is read then."""
        check_dimensions(self.points, queries)
        home = search_leaves(self.leaves, leaf_table(queries, [self.tree], "qid"), k, self.metric, exclude_self=exclude_self)
        reach = home.groupBy("qid").agg(F.max("dist").alias("r"), F.count("*").alias("n"))
        asked = queries.select("qid", "vec").join(reach, "qid", "left").select("qid", "vec", F.when(F.col("n") >= k, F.col("r")).otherwise(F.lit(float("inf"))).alias("r"))
        low, high, metric = self.low, self.high, self.metric

        def near(batches):
            for batch in batches:
                q, r = vectors(batch.column(1)), batch.column(2).to_numpy()
                if len(q):
                    gap = np.maximum(np.maximum(low[None] - q[:, None], q[:, None] - high[None]), 0.0)
                    bound = pairwise(gap.reshape(-1, q.shape[1]), np.zeros((1, q.shape[1])), **metric).reshape(len(q), -1)
                    i, leaf = np.nonzero((bound <= r[:, None] * (1 + 1e-12)) & np.isfinite(low[:, 0])[None])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), pa.array(np.zeros(len(i), np.int32)), pa.array(leaf)], ["qid", "vec", "tree", "leaf"])

        return search_leaves(self.leaves, stream(asked, near, "qid long, vec array<double>, tree int, leaf long", rows=256), k, self.metric, exclude_self=exclude_self)


__all__ = ["Forest", "KdTree", "Tree"]
