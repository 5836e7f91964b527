"""Ollivier-Ricci curvature of the edges of a neighbour graph: kappa = 1 - W1 / d."""
from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import distance, pairwise
from .graph import canonical, effective_epsilon, mirror, with_neighbourhoods
from .knn import stream
from .paths import adjacency_of, pair_paths
from .transport import wasserstein


@dataclass(frozen=True)
class Profile:
    """How effective lengths count an edge's ends, and whether only the target's list leaves out the other end."""

    exact: bool = False


@dataclass(frozen=True)
class Standard:
    """Straight distances; neighbourhoods keep the edge's ends."""


@dataclass(frozen=True)
class Manifold:
    """Costs are path lengths in effective epsilons; the denominator is the edge's own; ends are left out."""

    profile: Profile = Profile()


def curvatures(edges: DataFrame, points: DataFrame, original_k: int, variant: Standard | Manifold = Standard(), solver: str = "exact", fallback: str = "exact") -> DataFrame:
    """(src, dst, kappa, w1, edge_dist) for every edge of edges (src, dst, dist). Both directions of an edge are solved once.

    A denominator of 0 gives NaN or an infinity, as in floating-point arithmetic. Coordinates travel with the edges for the standard
    variant; for the manifold variant the adjacency is broadcast (its size is checked)."""
    if isinstance(variant, Standard):
        base = canonical(edges.select("src", "dst", "dist")).select("src", "dst", F.col("dist").alias("edge_dist"))
        ready = with_neighbourhoods(base, edges)
        x = points.select(F.col("id").alias("n"), "vec")
        local = ready.select("src", "dst", F.explode(F.array_union("nx", "ny")).alias("n")).join(x, "n").groupBy("src", "dst").agg(F.collect_list(F.struct("n", "vec")).alias("local"))
        ready = ready.join(local, ["src", "dst"]).select("src", "dst", "edge_dist", "nx", "ny", "local")

        def run(batches):
            for batch in batches:
                rows = []
                for s, t, d, nx, ny, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = {e["n"]: k for k, e in enumerate(held)}
                    coords = np.array([e["vec"] for e in held])
                    cost = lambda a, b, at=at, coords=coords: pairwise(coords[[at[i] for i in a]], coords[[at[j] for j in b]])
                    rows.append((s, t, wasserstein(nx, ny, cost, solver, fallback), d))
                yield _table(rows)

        solved = stream(ready, run, "src long, dst long, kappa double, w1 double, edge_dist double", rows=256)
    else:
        eps = effective_epsilon(edges, original_k, variant.profile.exact)
        graph = adjacency_of(edges.join(eps, ["src", "dst"]).select("src", "dst", F.col("eps").alias("dist")), points.select("id"))
        shared = points.sparkSession.sparkContext.broadcast(graph)
        base = canonical(edges.select("src", "dst", "dist")).select("src", "dst").join(eps, ["src", "dst"])
        one_sided = variant.profile.exact

        def without(nbrs: list[int], other: int) -> list[int]:
            return [n for n in nbrs if n != other] or nbrs

        def run(batches):
            g, known = shared.value, {}

            def row(i):
                if i not in known:
                    if len(known) > 2048:
                        known.clear()
                    known[i] = g.dijkstra({g.place(i): 0.0})[0]
                return known[i]

            def cost(a, b):
                places = [g.place(j) for j in b]
                return np.array([row(i)[places] for i in a])

            for batch in batches:
                rows = []
                for s, t, d, nx, ny in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    rows.append((s, t, wasserstein(nx if one_sided and t not in nx else without(nx, t), without(ny, s), cost, solver, fallback), d))
                yield _table(rows)

        ready = with_neighbourhoods(base.select("src", "dst", F.col("eps").alias("edge_dist")), edges).select("src", "dst", "edge_dist", "nx", "ny").repartition(points.sparkSession.sparkContext.defaultParallelism, "src")
        solved = stream(ready, run, "src long, dst long, kappa double, w1 double, edge_dist double", rows=256)
    return mirror(solved, edges)


DISTANCES = ("euclidean", "geodesic_euclidean", "geodesic_normalized", "geodesic_unit", "normalized")


def pair_distances(pairs: DataFrame, edges: DataFrame, points: DataFrame, name: str, original_k: int, profile: Profile = Profile()) -> DataFrame:
    """(src, dst, d) for pairs by one of DISTANCES: straight; along the graph by edge lengths, by effective epsilons, or by number of edges; or the pair's own effective epsilon.
    Ways along a directed graph need not be symmetric, which is warned of."""
    if name not in DISTANCES:
        raise ValueError(f"unknown distance {name}; there are {', '.join(DISTANCES)}")
    if name == "euclidean":
        x, y = points.select(F.col("id").alias("src"), F.col("vec").alias("_x")), points.select(F.col("id").alias("dst"), F.col("vec").alias("_y"))
        return pairs.select("src", "dst").join(x, "src").join(y, "dst").select("src", "dst", distance("_x", "_y").alias("d"))
    if name == "normalized":
        # A pair that is no edge has the epsilons of its ends all the same.
        means = effective_epsilon(edges, original_k, profile.exact, pairs)
        return means.select("src", "dst", F.col("eps").alias("d"))
    if is_directed(edges):
        warnings.warn("ways along a directed graph can differ by direction", stacklevel=2)
    if name == "geodesic_normalized":
        weighted = edges.select("src", "dst").join(effective_epsilon(edges, original_k, profile.exact), ["src", "dst"]).withColumnRenamed("eps", "dist")
    else:
        weighted = edges if name == "geodesic_euclidean" else edges.select("src", "dst", F.lit(1.0).alias("dist"))
    return pair_paths(weighted, pairs).select("src", "dst", "d")


def is_directed(edges: DataFrame) -> bool:
    """Whether some edge lacks its reverse."""
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return not edges.select("src", "dst").join(turned, ["src", "dst"], "left_anti").isEmpty()


def _table(rows: list[tuple]) -> pa.RecordBatch:
    def kappa(w: float, d: float) -> float:
        return 1 - w / d if d else float("nan") if not w or math.isnan(w) else -math.inf

    return pa.RecordBatch.from_pydict({"src": pa.array([r[0] for r in rows], pa.int64()), "dst": pa.array([r[1] for r in rows], pa.int64()), "kappa": pa.array([kappa(r[2], r[3]) for r in rows], pa.float64()), "w1": pa.array([r[2] for r in rows], pa.float64()), "edge_dist": pa.array([r[3] for r in rows], pa.float64())})


__all__ = ["DISTANCES", "Manifold", "Profile", "Standard", "curvatures", "is_directed", "pair_distances"]
