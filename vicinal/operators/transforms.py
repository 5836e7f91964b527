"""Transforms of vectors: k-means, principal components, random projection."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import gemm_sqeuclidean, pairwise
from .knn import stream, vectors


def identity(points: DataFrame) -> DataFrame:
    return points


@dataclass
class KMeans:
    """Centroids; a point's bucket is the nearest one, the lowest of equally near ones."""

    centroids: np.ndarray

    @staticmethod
    def plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
        """Starting centroids, each drawn by squared distance from those before."""
        draws = np.random.default_rng(seed)
        chosen = [int(draws.integers(len(x)))]
        near = pairwise(x, x[chosen], "sqeuclidean")[:, 0]
        while len(chosen) < k:
            total = np.cumsum(near)
            at = int(np.searchsorted(total, draws.random() * total[-1], side="right")) if total[-1] > 0 else next(j for j in range(len(x)) if j not in chosen)
            chosen.append(min(at, len(x) - 1))
            near = np.minimum(near, pairwise(x, x[chosen[-1:]], "sqeuclidean")[:, 0])
        return x[chosen]

    @classmethod
    def fit(cls, points: DataFrame, k: int, rounds: int = 25, seed: int = 0, init: str = "plus_plus", sample: int = 32_768, tolerance: float = 0.0, start: np.ndarray | None = None) -> KMeans:
        """Lloyd rounds over all points; the start is drawn from a hashed sample of bounded size. An empty cluster takes
        the point farthest from its centroid, each empty cluster another."""
        if start is None:
            n = points.count()
            if k > n:
                raise ValueError("more clusters than points")
            limit = max(sample, k)
            rows = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(limit).toArrow()
            x = vectors(rows.column("vec"))
            start = cls.plus_plus(x, k, seed) if init == "plus_plus" else x[:k]
        model = cls(np.array(start, float))
        for _ in range(rounds):
            before = model.centroids
            model = model.step(points)
            if np.sqrt(((model.centroids - before) ** 2).sum(axis=1)).max() <= tolerance:
                break
        return model

    @classmethod
    def local(cls, x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
        """Centroids of points that one task holds, at most as many as there are distinct points."""
        c = cls.plus_plus(x, min(k, len(np.unique(x, axis=0))), seed)
        for _ in range(rounds):
            own = gemm_sqeuclidean(x, c).argmin(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=len(c))
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        return c

    def step(self, points: DataFrame) -> KMeans:
        """One round: partial sums of clusters and the farthest points of each batch, combined before the driver sees them."""
        c = self.centroids

        def partial(batches):
            sums, counts, far = np.zeros_like(c), np.zeros(len(c), np.int64), []
            for batch in batches:
                x, ids = vectors(batch.column(1)), batch.column(0).to_numpy()
                if not len(x):
                    continue
                d = pairwise(x, c, "sqeuclidean")
                own = d.argmin(axis=1)
                np.add.at(sums, own, x)
                counts += np.bincount(own, minlength=len(c))
                far = sorted(far + [(-d[j, own[j]], int(ids[j]), x[j].tolist()) for j in np.argsort(-d[np.arange(len(x)), own], kind="stable")[: len(c)]])[: len(c)]
            yield pa.RecordBatch.from_pydict({"kind": pa.array([0] * len(c) + [1] * len(far), pa.int32()), "at": pa.array([*range(len(c)), *[i for _, i, _ in far]], pa.int64()), "n": pa.array([*counts.tolist(), *[0] * len(far)], pa.int64()), "d": pa.array([*[0.0] * len(c), *[d for d, _, _ in far]], pa.float64()), "vec": pa.array([*sums.tolist(), *[v for *_, v in far]], pa.list_(pa.float64()))})

        rows = stream(points.select("id", "vec"), partial, "kind int, at long, n long, d double, vec array<double>")
        dims = c.shape[1]
        total = rows.where("kind = 0").groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.col("vec")[j]).alias(f"s{j}") for j in range(dims)]).collect()
        out, empty = c.copy(), set(range(len(c)))
        for r in total:
            if r["n"]:
                out[r["at"]] = np.array([r[f"s{j}"] for j in range(dims)]) / r["n"]
                empty.discard(r["at"])
        if empty:
            far = rows.where("kind = 1").orderBy("d", "at").limit(len(empty)).collect()
            for j, r in zip(sorted(empty), far, strict=False):
                out[j] = r["vec"]
        return KMeans(out)

    def transform(self, points: DataFrame, key: str = "id") -> DataFrame:
        """key, vec, distances to all centroids, bucket."""
        c = self.centroids

        def run(batches):
            for batch in batches:
                d = pairwise(vectors(batch.column(1)), c) if batch.num_rows else np.zeros((0, len(c)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.tolist(), pa.list_(pa.float64())), pa.array(d.argmin(axis=1).astype(np.int32) if len(d) else [], pa.int32())], [*batch.schema.names, "distances", "bucket"])

        return stream(points.select(key, "vec"), run, f"{key} long, vec array<double>, distances array<double>, bucket int")


@dataclass
class Pca:
    """Mean, axes (rows, by falling variance, the largest entry positive), and their variances."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray

    @classmethod
    def fit(cls, points: DataFrame, target_dim: int | None = None, variance: float = 0.95) -> Pca:
        """From centred moments added up over all points: one pass for the mean and one for the covariance."""
        dims = points.select(F.size("vec")).first()[0]
        mean = np.array(points.agg(*[F.avg(F.col("vec")[j]) for j in range(dims)]).first(), float)

        def moments(batches):
            total, n = np.zeros((dims, dims)), 0
            for batch in batches:
                x = vectors(batch.column(0)).reshape(-1, dims) - mean
                total, n = total + x.T @ x, n + len(x)
            yield pa.RecordBatch.from_pydict({"j": np.arange(dims), "row": pa.array(total.tolist(), pa.list_(pa.float64())), "n": np.full(dims, n)})

        rows = stream(points.select("vec"), moments, "j long, row array<double>, n long").groupBy("j").agg(F.sum("n").alias("n"), *[F.sum(F.col("row")[i]).alias(f"c{i}") for i in range(dims)]).orderBy("j").collect()
        covariance = np.array([[r[f"c{i}"] for i in range(dims)] for r in rows]) / max(1, rows[0]["n"] - 1)
        values, axes = np.linalg.eigh(covariance)
        values, axes = values[::-1].clip(0), axes[:, ::-1].T
        axes = axes * np.sign(axes[np.arange(dims), np.abs(axes).argmax(axis=1)])[:, None]
        keep = target_dim or int(np.searchsorted(np.cumsum(values) / values.sum(), variance - 1e-12) + 1)
        return cls(mean, axes[:keep], values[:keep])

    @property
    def target_dimension(self) -> int:
        return len(self.axes)

    @property
    def explained_variance_ratio(self) -> np.ndarray:
        """Shares among the kept axes."""
        return self.variances / self.variances.sum()

    def _map(self, points: DataFrame, fn) -> DataFrame:
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vec": pa.array(fn(vectors(batch.column(1))).tolist() if batch.num_rows else [], pa.list_(pa.float64()))})

        return stream(points.select("id", "vec"), run, "id long, vec array<double>")

    def transform(self, points: DataFrame) -> DataFrame:
        return self._map(points, lambda x: (x - self.mean) @ self.axes.T)

    def inverse_transform(self, points: DataFrame) -> DataFrame:
        return self._map(points, lambda y: y @ self.axes + self.mean)


@dataclass
class RandomProjection:
    """Rows of a fixed matrix; built-in expressions only."""

    rows: list[list[float]]

    @classmethod
    def make(cls, dims: int, target: int, seed: int, density: float | None = None) -> RandomProjection:
        draws = np.random.default_rng(seed)
        if density is None:
            rows = draws.standard_normal((target, dims)) / np.sqrt(target)
        else:
            rows = np.where(draws.random((target, dims)) < density, draws.choice([-1.0, 1.0], (target, dims)), 0.0) / np.sqrt(density * target)
        return cls(np.round(rows, 9).tolist())

    @staticmethod
    def suggested_dimension(n: int, epsilon: float) -> int:
        return int(np.ceil(8 * np.log(n) / epsilon**2))

    def transform(self, points: DataFrame) -> DataFrame:
        parts = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(x) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for row in self.rows]
        return points.select("id", F.array(*parts).alias("vec"))
