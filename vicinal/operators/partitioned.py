"""Inverted lists and nested indexes: buckets of transforms, routing to some of them, and merging."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import distance, pairwise
from .knn import Searchable, check_dimensions, stream, top_k, vectors
from .nndescent import cut
from .transforms import KMeans
from .trees import search_leaves


def top_routing(k: int) -> Callable[[str], Column]:
    """The k nearest buckets (slots are chosen before empty buckets drop out), the lowest number first among equals."""
    return lambda distances: F.transform(F.slice(F.array_sort(F.transform(distances, lambda d, j: F.struct(d.alias("d"), j.alias("j")))), 1, max(1, k)), lambda s: s["j"])


def exhaustive_routing() -> Callable[[str], Column]:
    return lambda distances: F.sequence(F.lit(0), F.size(distances) - 1)


def select_buckets(distances: list[float], children: int, k: int) -> list[int]:
    """Numbers (from 1) of the at most k nearest existing children; ValueError without distances."""
    if not distances:
        raise ValueError("no distances to route by")
    order = sorted(range(len(distances)), key=lambda j: (distances[j], j))
    return [j + 1 for j in order if j < children][: max(0, k)]


def simple_merge(parts: DataFrame, k: int) -> DataFrame:
    """The top k of parts (qid, id, dist) that may repeat ids: the least distance of each counts."""
    return top_k(parts.groupBy("qid", "id").agg(F.min("dist").alias("dist")), k)


def disjoint_merge(parts: DataFrame, k: int) -> DataFrame:
    """The top k of parts whose ids never repeat."""
    return top_k(parts, k)


@dataclass
class IvfFlat(Searchable):
    """Lists of points by nearest centroid; a query reads the lists of its nprobe nearest centroids."""

    model: KMeans
    lists: DataFrame
    metric: str = "euclidean"

    @classmethod
    def build(cls, points: DataFrame, nlist: int, seed: int = 0, rounds: int = 25, start: np.ndarray | None = None, metric: str = "euclidean") -> IvfFlat:
        check_dimensions(points)
        model = KMeans.fit(points, nlist, rounds, seed, sample=max(256 * nlist, 32_768), start=start)
        return cls(model, model.transform(points).select("id", "vec", "bucket"), metric)

    def search(self, queries: DataFrame, k: int, nprobe: int = 10) -> DataFrame:
        check_dimensions(self.lists, queries)
        route = top_routing(nprobe)
        probes = self.model.transform(queries, "qid").select("qid", "vec", F.explode(route("distances")).alias("bucket"))
        scored = probes.withColumnRenamed("vec", "_q").join(self.lists, "bucket").select("qid", "id", distance("_q", "vec", self.metric).alias("dist"))
        return disjoint_merge(scored, k)


@dataclass(frozen=True)
class Terminal:
    """Exact scan of what reaches it."""

    metric: str = "euclidean"


@dataclass(frozen=True)
class Transformed:
    """k-means into `buckets`, a routing to `probes` of them (all if None), and what stands below."""

    buckets: int
    child: Transformed | Terminal = field(default_factory=Terminal)
    probes: int | None = None
    seed: int = 0


#: Points of a bucket that its centroids are fitted to.
SAMPLE = 32_768


@dataclass
class MultiLevel(Searchable):
    """A tree of transforms, as a path column of bucket numbers. Every level is one more join key; ids stay global."""

    config: Transformed | Terminal
    models: list[dict[str, np.ndarray]]
    points: DataFrame

    @classmethod
    def build(cls, points: DataFrame, config: Transformed | Terminal, rounds: int = 10) -> MultiLevel:
        """One grouped pass fits all buckets of a level, each from a hashed sample of at most SAMPLE points, and one pass deals the points."""
        check_dimensions(points)
        level, frame, models = config, points.select("id", "vec", F.lit("").alias("path")), []
        while isinstance(level, Transformed):
            fitted = cls._fit(frame, level, rounds)
            models.append(fitted)
            frame = cut(cls._route(frame, fitted, 1, "id"))
            level = level.child
        return cls(config, models, frame)

    @staticmethod
    def _fit(frame: DataFrame, level: Transformed, rounds: int) -> dict[str, np.ndarray]:
        """Centroids by path. Their number is that of the level's buckets, which the configuration bounds."""
        order = Window.partitionBy("path").orderBy(F.xxhash64("id", F.lit(level.seed)), "id")
        sample = frame.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= SAMPLE).drop("_r")
        buckets, seed = level.buckets, level.seed

        def run(key, rows):
            by = np.argsort(rows.column("id").to_numpy(), kind="stable")
            return pa.table({"path": [key[0].as_py()], "centroids": [KMeans.local(vectors(rows.column("vec"))[by], buckets, rounds, seed).tolist()]})

        found = sample.groupBy("path").applyInArrow(run, "path string, centroids array<array<double>>").collect()
        return {r["path"]: np.array(r["centroids"], float) for r in found}

    @staticmethod
    def _route(frame: DataFrame, fitted: dict[str, np.ndarray], probes: int | None, key: str) -> DataFrame:
        """(key, vec, path) with each row's nearest buckets, all of them without probes. Rows under a path that no point has drop out."""

        def run(batches):
            for batch in batches:
                paths, x = np.array(batch.column(2).to_pylist()), vectors(batch.column(1))
                rows, names = [], []
                for path in np.unique(paths).tolist():
                    if path in fitted:
                        own = np.flatnonzero(paths == path)
                        d = pairwise(x[own], fitted[path])
                        near = np.argsort(d, axis=1, kind="stable")[:, : len(fitted[path]) if probes is None else probes]
                        rows.append(np.repeat(own, near.shape[1]))
                        names += [f"{path}/{j}" for j in near.ravel().tolist()]
                at = pa.array(np.concatenate(rows) if rows else np.zeros(0, int))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(names, pa.string())], [key, "vec", "path"])

        return stream(frame.select(key, "vec", "path"), run, f"{key} long, vec array<double>, path string")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        check_dimensions(self.points, queries)
        level, frame = self.config, queries.select("qid", "vec", F.lit("").alias("path"))
        for fitted in self.models:
            frame = self._route(frame, fitted, level.probes, "qid")
            level = level.child
        # Rows of a path meet in one task as a leaf's do, so that only the k best of each query leave it. The configuration bounds the number of paths.
        names = [f"{path}/{j}" for path, c in (self.models[-1] if self.models else {}).items() for j in range(len(c))] or [""]
        placed = lambda df, key: df.select(key, "vec", F.lit(0).alias("tree"), F.array_position(F.array(*map(F.lit, names)), F.col("path")).alias("leaf"))
        return search_leaves(placed(self.points, "id"), placed(frame, "qid"), k, {"metric": level.metric})
