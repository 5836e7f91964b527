"""Shortest paths and geodesics on neighbour graphs, and refinement of paths.

Sources are dealt over tasks; the adjacency is broadcast, so its size is checked first (MOST_EDGES). Beyond it, `hop_relax` relaxes
all sources at once by joins, round after round.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import pairwise
from .geometry import PcaMethod, curvature_indicator
from .knn import search, stream, vectors
from .nndescent import cut

#: Edges of an adjacency that tasks hold: 12 bytes each.
MOST_EDGES = 20_000_000
#: Numbers of all geometries that tasks hold: eight bytes each.
MOST_NUMBERS = 30_000_000


class Adjacency:
    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, ids: np.ndarray | None = None):
        self.ids = np.unique(np.concatenate([src, dst] if ids is None else [src, dst, ids]))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        by = np.argsort(s, kind="stable")
        self.to, self.weight = d[by], weight[by]
        self.first = np.searchsorted(s[by], np.arange(len(self.ids) + 1))

    def place(self, node: int) -> int:
        at = int(np.searchsorted(self.ids, node))
        return at if at < len(self.ids) and self.ids[at] == node else -1

    def dijkstra(self, starts: dict[int, float], target: int | None = None, skip: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and predecessors (places, -1 for none) from starts (place: offset); stops at a target place; an edge may be left out."""
        dist, prev = np.full(len(self.ids), np.inf), np.full(len(self.ids), -1)
        heap = [(d, s) for s, d in starts.items()]
        for d, s in heap:
            dist[s] = min(dist[s], d)
        heapq.heapify(heap)
        while heap:
            d, i = heapq.heappop(heap)
            if d > dist[i]:
                continue
            if i == target:
                break
            a, b = self.first[i], self.first[i + 1]
            for j, w in zip(self.to[a:b].tolist(), self.weight[a:b].tolist(), strict=True):
                if skip != (i, j) and d + w < dist[j]:
                    dist[j], prev[j] = d + w, i
                    heapq.heappush(heap, (d + w, j))
        return dist, prev

    def path(self, prev: np.ndarray, start: int, end: int) -> list[int]:
        out = [end]
        while out[-1] != start:
            if prev[out[-1]] < 0:
                return []
            out.append(int(prev[out[-1]]))
        return [int(self.ids[i]) for i in reversed(out)]


def adjacency_of(edges: DataFrame, nodes: DataFrame | None = None, weight: str = "dist") -> Adjacency:
    if edges.count() > MOST_EDGES:
        raise ValueError("too many edges for one task's memory; use hop_relax")
    if nodes is not None and nodes.count() > MOST_EDGES:
        raise ValueError("too many nodes for one task's memory; use hop_relax")
    held = edges.groupBy("src", "dst").agg(F.min(weight).alias("w")).toArrow()
    return Adjacency(held.column("src").to_numpy(), held.column("dst").to_numpy(), held.column("w").to_numpy().astype(float), None if nodes is None else nodes.select("id").toArrow().column("id").to_numpy())


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "dist") -> DataFrame:
    """(src, dst, d) for all nodes that each source (column id) reaches, itself at 0."""
    graph = adjacency_of(edges, sources, weight)
    shared = edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        g = shared.value
        for batch in batches:
            for s in batch.column(0).to_pylist():
                dist, _ = g.dijkstra({g.place(s): 0.0})
                at = np.flatnonzero(np.isfinite(dist))
                yield pa.RecordBatch.from_pydict({"src": np.full(len(at), s, np.int64), "dst": g.ids[at], "d": dist[at]})

    return stream(sources.select("id").repartition(sources.sparkSession.sparkContext.defaultParallelism), run, "src long, dst long, d double", rows=64)


def hop_relax(edges: DataFrame, sources: DataFrame, rounds: int | None = None, weight: str = "dist") -> DataFrame:
    """Distances by joins: over at most `rounds` edges, or over any number, until a round changes nothing. Weights are not negative."""
    e = edges.groupBy(F.col("src").alias("m"), "dst").agg(F.min(weight).alias("w"))
    reached = sources.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("d")).distinct()
    if rounds is None:
        e = cut(e)
        reached = cut(reached.withColumn("fresh", F.lit(True)))
        while True:
            further = reached.where("fresh").select("src", F.col("dst").alias("m"), "d").join(e, "m").select("src", "dst", (F.col("d") + F.col("w")).alias("d"))
            old = reached.select("src", "dst", "d", F.col("d").alias("had"))
            best = old.union(further.withColumn("had", F.lit(None).cast("double"))).groupBy("src", "dst").agg(F.min("d").alias("d"), F.min("had").alias("had"))
            reached = cut(best.select("src", "dst", "d", (F.col("had").isNull() | (F.col("d") < F.col("had"))).alias("fresh")))
            if reached.where("fresh").isEmpty():
                return reached.select("src", "dst", "d")
    for r in range(rounds):
        further = reached.withColumnRenamed("dst", "m").join(e, "m").select("src", "dst", (F.col("d") + F.col("w")).alias("d"))
        reached = reached.union(further).groupBy("src", "dst").agg(F.min("d").alias("d"))
        if r % 3 == 2:
            reached = cut(reached)
    return reached


def pair_paths(edges: DataFrame, pairs: DataFrame, weight: str = "dist") -> DataFrame:
    """(src, dst, d, path) for pairs; infinity and an empty path where there is no way."""
    graph = adjacency_of(edges, pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), weight)
    shared = edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches):
        g = shared.value
        for batch in batches:
            rows = []
            for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                dist, prev = g.dijkstra({g.place(s): 0.0}, g.place(t))
                rows.append((s, t, float(dist[g.place(t)]), g.path(prev, g.place(s), g.place(t))))
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64()), "d": pa.array(c, pa.float64()), "path": pa.array(d, pa.list_(pa.int64()))})

    return stream(pairs.select("src", "dst"), run, "src long, dst long, d double, path array<long>", rows=256)


def entries_of(points: DataFrame, queries: DataFrame, entry_k: int, method: PcaMethod) -> DataFrame:
    """(qid, e): of each outside point (qid, vec) the entry_k nearest nodes with their local distances, the lengths of the offsets within the tangent space that the entries span."""
    queries = queries.select(F.col("qid").cast("long"), "vec")
    near = search(points, queries, entry_k).join(points.select("id", F.col("vec").alias("y")), "id").join(queries, "qid")

    def run(key, rows):
        by = np.argsort(rows.column("rank").to_numpy())
        x, y = np.array(rows.column("vec")[0].as_py(), float), vectors(rows.column("y"))[by]
        basis, _ = method.fit(x, y)
        local = np.linalg.norm((y - x) @ basis, axis=1)
        entries = [{"id": int(i), "dist": float(d)} for i, d in zip(rows.column("id").to_numpy()[by], local, strict=True)]
        return pa.table({"qid": [key[0].as_py()], "e": pa.array([entries], pa.list_(pa.struct([("id", pa.int64()), ("dist", pa.float64())])))})

    return near.groupBy("qid").applyInArrow(run, "qid long, e array<struct<id: long, dist: double>>")


def point_geodesics(points: DataFrame, edges: DataFrame, queries: DataFrame, targets: DataFrame, entry_k: int = 5, method: PcaMethod | None = None) -> DataFrame:
    """(qid, dst, d): from each outside point (qid, vec) over its entry_k nearest nodes to each target node (column id), by one run with several starts.
    The way to an entry is as long as within the tangent space fitted at the point. Targets are nodes, so they are bounded as the adjacency is."""
    graph = adjacency_of(edges, points.select("id"))
    ends = targets.select(F.col("id").cast("long")).distinct()
    if ends.count() > MOST_EDGES:
        raise ValueError("too many targets for one task's memory")
    shared = edges.sparkSession.sparkContext.broadcast((graph, ends.toArrow().column("id").to_numpy()))
    entries = entries_of(points, queries, entry_k, method or PcaMethod())

    def run(batches):
        g, ends = shared.value
        at = np.array([g.place(t) for t in ends], int)
        for batch in batches:
            for qid, entry in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                dist, _ = g.dijkstra({g.place(e["id"]): e["dist"] for e in entry})
                yield pa.RecordBatch.from_pydict({"qid": np.full(len(ends), qid, np.int64), "dst": ends, "d": dist[at]})

    return stream(entries, run, "qid long, dst long, d double", rows=64)


def point_pair_geodesics(points: DataFrame, edges: DataFrame, queries: DataFrame, pairs: DataFrame, entry_k: int = 5, method: PcaMethod | None = None) -> DataFrame:
    """(a, b, d) for pairs (a, b) of outside points (qid, vec): the least of local way, graph way and local way over the entries of both."""
    graph = adjacency_of(edges, points.select("id"))
    shared = edges.sparkSession.sparkContext.broadcast(graph)
    entries = entries_of(points, queries, entry_k, method or PcaMethod())
    both = pairs.select(F.col("a").cast("long"), F.col("b").cast("long")).join(entries.select(F.col("qid").alias("a"), F.col("e").alias("ea")), "a").join(entries.select(F.col("qid").alias("b"), F.col("e").alias("eb")), "b")

    def run(batches):
        g = shared.value
        for batch in batches:
            out = []
            for ea, eb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                dist, _ = g.dijkstra({g.place(e["id"]): e["dist"] for e in ea})
                out.append(min(float(dist[g.place(e["id"])]) + e["dist"] for e in eb))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], ["a", "b", "d"])

    return stream(both.select("a", "b", "ea", "eb"), run, "a long, b long, d double", rows=256)


@dataclass
class GeodesicModel:
    """A weighted graph on points with what its distances need. `edges` are (src, dst, dist), dist being the chosen weight."""

    points: DataFrame
    edges: DataFrame
    geometry: DataFrame
    k: int
    method: PcaMethod

    @classmethod
    def build(cls, points: DataFrame, k: int = 10, method: PcaMethod | None = None, weight: str = "chord", candidate_k: int | None = None) -> GeodesicModel:
        """From the k-nearest-neighbour graph; `weight` names a column of geometry.edge_weights."""
        from .geometry import weighted_graph

        method = method or PcaMethod()
        edges, geometry = weighted_graph(points, k, method, weight, candidate_k)
        return cls(points, cut(edges), cut(geometry), k, method)

    def node_to_node(self, pairs: DataFrame) -> DataFrame:
        return pair_paths(self.edges, pairs)

    def point_to_node(self, queries: DataFrame, targets: DataFrame, entry_k: int = 5) -> DataFrame:
        return point_geodesics(self.points, self.edges, queries, targets, entry_k, self.method)

    def point_to_point(self, queries: DataFrame, pairs: DataFrame, entry_k: int = 5) -> DataFrame:
        return point_pair_geodesics(self.points, self.edges, queries, pairs, entry_k, self.method)


def path_segments(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, step, a, b, w): a path's edges with their weights; one that is missing has the mean weight."""
    steps = paths.select("src", "dst", F.posexplode("path").alias("step", "a"))
    following = F.lead("a").over(Window.partitionBy("src", "dst").orderBy("step"))
    legs = steps.withColumn("b", following).where("b is not null")
    mean = edges.agg(F.avg("dist").alias("_mean"))
    known = legs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dist").alias("w")), ["a", "b"], "left")
    return known.join(F.broadcast(mean), F.lit(True)).select("src", "dst", "step", "a", "b", F.coalesce("w", "_mean").alias("w"))


def corrected(d: float, indicator: float, length_scale: float) -> float:
    """A segment's length corrected for curvature: d (1 + (kappa d)^2 / 24) with kappa = indicator / length_scale."""
    k = indicator / length_scale
    return d * (1 + (k * d) ** 2 / 24)


def subdivide(line: np.ndarray, parts: int) -> np.ndarray:
    """Each segment cut into equal parts."""
    if len(line) < 2:
        return line
    t = np.arange(parts)[:, None] / parts
    return np.concatenate([*(a + t * (b - a) for a, b in zip(line, line[1:], strict=False)), line[-1:]])


@dataclass
class Geometries:
    """Centres, tangent bases and curvature indicators of all nodes, for the nearest one to any point (the least id among equally near ones)."""

    centers: np.ndarray
    bases: list[np.ndarray]
    indicators: np.ndarray

    @classmethod
    def collect(cls, points: DataFrame, geometry: DataFrame) -> Geometries:
        """All nodes' geometries, in order of id; their size is checked."""
        held = points.select("id", "vec").join(geometry.select("id", "basis", "eig"), "id")
        if (held.agg(F.sum(F.size("vec") * (F.lit(1) + F.size(F.col("basis")[0])))).first()[0] or 0) > MOST_NUMBERS:
            raise ValueError("too many geometries for one task's memory")
        rows = held.orderBy("id").toArrow()
        return cls(vectors(rows.column("vec")), [np.array(b, float) for b in rows.column("basis").to_pylist()], np.array([curvature_indicator(e) for e in rows.column("eig").to_pylist()]))

    def nearest(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), int)
        for k in range(0, len(x), 256):
            out[k : k + 256] = pairwise(x[k : k + 256], self.centers, "sqeuclidean").argmin(axis=1)
        return out

    def within_tangent(self, x: np.ndarray, moves: np.ndarray) -> np.ndarray:
        """The part of each move that lies in the tangent space of the geometry nearest to its point."""
        return np.array([self.bases[n] @ (self.bases[n].T @ m) for n, m in zip(self.nearest(x).tolist(), moves, strict=True)]).reshape(moves.shape)


def smooth(line: np.ndarray, geometries: Geometries, parts: int = 5, rounds: int = 20, tolerance: float = 1e-4, rate: float = 0.5) -> np.ndarray:
    """Inner points move towards their neighbours' middle, within the tangent space of the nearest of all geometries shifted to the point, all at once in each round."""
    line = subdivide(line, parts)
    for _ in range(rounds):
        if len(line) < 3:
            break
        inner = line[1:-1]
        move = rate * geometries.within_tangent(inner, (line[:-2] + line[2:]) / 2 - inner)
        line = np.concatenate([line[:1], inner + move, line[-1:]])
        if np.linalg.norm(move, axis=1).max() < tolerance:
            break
    return line


def length(line: np.ndarray) -> float:
    return float(np.linalg.norm(np.diff(line, axis=0), axis=1).sum())


def refine_paths(paths: DataFrame, points: DataFrame, geometry: DataFrame, parts: int = 5, rounds: int = 20, corrections: bool = False, length_scale: float = 1.0, base: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """(src, dst, d_path, d_refined) of paths (src, dst, path): the length along the nodes and the refined one. With `base` paths are cut and smoothed along tangent spaces; without it
    segments are the path's own, as long as their edge (src, dst, dist) of `edges` says. With corrections each segment is lengthened by the curvature of the geometry nearest
    to its midpoint. The geometries of all nodes are broadcast (their size is checked); each task gets only the points of its own paths, by a join."""
    if length_scale <= 0:
        raise ValueError("length_scale must be positive")
    shared = paths.sparkSession.sparkContext.broadcast(Geometries.collect(points, geometry))
    flat = paths.select("src", "dst", F.posexplode("path").alias("step", "id")).join(points.select("id", "vec"), "id")
    if base or edges is None:
        flat = flat.withColumn("w", F.lit(None).cast("double"))
    else:
        legs = path_segments(paths, edges).select("src", "dst", "step", "w")
        flat = flat.join(legs, ["src", "dst", "step"], "left")

    def run(key, rows):
        by = np.argsort(rows.column("step").to_numpy())
        line, own = vectors(rows.column("vec"))[by], shared.value
        fine = smooth(line, own, parts, rounds) if base else line
        sizes = np.linalg.norm(np.diff(fine, axis=0), axis=1)
        weights = rows.column("w").to_numpy(zero_copy_only=False).astype(float)[by][:-1]
        if not np.isnan(weights).any():
            sizes = weights
        if corrections and len(fine) > 1:
            kappa = own.indicators[own.nearest((fine[1:] + fine[:-1]) / 2)]
            sizes = np.array([corrected(d, k, length_scale) for d, k in zip(sizes.tolist(), kappa.tolist(), strict=True)])
        return pa.table({"src": [key[0].as_py()], "dst": [key[1].as_py()], "d_path": [length(line)], "d_refined": [float(sizes.sum())]})

    return flat.groupBy("src", "dst").applyInArrow(run, "src long, dst long, d_path double, d_refined double")


def swiss_roll(spark, n: int) -> DataFrame:
    """(id, t, h, vec) on a spiral sheet, by a formula."""
    t = F.lit(1.5 * np.pi) + F.lit(3 * np.pi) * F.col("id") / n
    h = F.lit(10.0) * F.pmod(F.col("id") * F.lit(0.6180339887498949), F.lit(1.0))
    return spark.range(n).select("id", t.alias("t"), h.alias("h"), F.array(t * F.cos(t), h, t * F.sin(t)).alias("vec"))


def swiss_roll_distance(t1, h1, t2, h2):
    """The exact distance along the sheet, of columns."""
    arc = lambda t: (t * F.sqrt(1 + t * t) + F.asinh(t)) / 2
    return F.sqrt(F.pow(arc(t1) - arc(t2), F.lit(2)) + F.pow(h1 - h2, F.lit(2)))


def torus(spark, n: int, major: float = 2.0, minor: float = 1.0) -> DataFrame:
    """(id, u, v, vec) on a torus, by a formula, with its Gaussian curvature."""
    u = F.lit(2 * np.pi) * F.pmod(F.col("id") * F.lit(0.6180339887498949), F.lit(1.0))
    v = F.lit(2 * np.pi) * F.col("id") / n
    ring = F.lit(major) + F.lit(minor) * F.cos(v)
    return spark.range(n).select("id", u.alias("u"), v.alias("v"), F.array(ring * F.cos(u), ring * F.sin(u), F.lit(minor) * F.sin(v)).alias("vec"), (F.cos(v) / (F.lit(minor) * ring)).alias("curvature"))


def torus_distance(u1: float, v1: float, u2: float, v2: float, major: float = 2.0, minor: float = 1.0, cells: int = 64) -> float:
    """The length of the shortest way on a torus between two places (u, v), along a grid of cells x cells places with steps to the eight neighbours and the knight's moves."""
    step = 2 * np.pi / cells
    at = np.arange(cells * cells)
    i, j = at // cells, at % cells
    moves = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if (a or b) and np.gcd(a, b) == 1]
    src, dst, weight = [], [], []
    for a, b in moves:
        middle = (j + b / 2) * step
        src.append(at)
        dst.append((i + a) % cells * cells + (j + b) % cells)
        weight.append(np.hypot((major + minor * np.cos(middle)) * a * step, minor * b * step))
    grid = Adjacency(*(np.concatenate(x) for x in (src, dst, weight)))
    place = lambda u, v: int(round(u / step)) % cells * cells + int(round(v / step)) % cells
    start, end = place(u1, v1), place(u2, v2)
    return float(grid.dijkstra({start: 0.0}, end)[0][end])


def analytic_length(paths: DataFrame, points: DataFrame, distance) -> DataFrame:
    """(src, dst, d): the sum of distance(a, b) over a path's steps; a and b name struct columns of the points' own columns."""
    nodes = points.select("id", F.struct(*[c for c in points.columns if c != "id"]).alias("p"))
    steps = paths.select("src", "dst", F.posexplode("path").alias("step", "id")).join(nodes, "id")
    legs = steps.withColumn("q", F.lead("p").over(Window.partitionBy("src", "dst").orderBy("step"))).where("q is not null")
    return legs.groupBy("src", "dst").agg(F.sum(distance(F.col("p"), F.col("q"))).alias("d"))
