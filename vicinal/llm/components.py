"""Connected components by alternating large-star and small-star rounds, all on executors.

A round replaces every edge by edges to the smallest neighbour. Node degrees only matter to aggregations, which combine
before the shuffle, and to joins, which Spark may split when skewed. Each round is cut by a checkpoint in the shared folder.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_stream


def local_labels(n: int, u: np.ndarray, v: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of n indexes by the edges (u, v)."""
    labels = np.arange(n) if labels is None else labels.copy()
    if len(u) == 0:
        return labels
    while True:
        a, b = labels[u], labels[v]
        open_edges = a != b
        if not open_edges.any():
            return labels
        u, v, a, b = u[open_edges], v[open_edges], a[open_edges], b[open_edges]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further


def stars(batches, rows: int = 65_536):
    """Arrow batches of edges (u, v) as stars of the same components, some `rows` edges at once."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([np.asarray(batch.column(k)) for batch in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        labels = local_labels(len(nodes), at[: len(u)], at[len(u) :])
        far = labels != np.arange(len(nodes))
        return pa.RecordBatch.from_pydict({"u": nodes[far], "v": nodes[labels[far]]})

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield star(held)
            held = []
    if held:
        yield star(held)


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges (u, v) as stars of the same components; nothing is shuffled."""
    return map_stream(edges.select("u", "v"), stars, "u long, v long", rows=65_536)


def connected_components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """node and root (the smallest node reachable) for every node of edges (u long, v long, not null), in any direction.
    Without contract, edges are a task's stars already: a Python step on top of the one that made them would take a second worker for each task,
    and workers stay, with all that later steps keep in them."""
    edges = edges.where("u <> v")
    edges = cut((contracted(edges) if contract else edges.select("u", "v")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Now u > v in all rows.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
