"""Neighbour graphs as edge tables: construction, set operations, signals, statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import search

MEDIAN = F.percentile


def knn_graph(points: DataFrame, k: int, include_self: bool = False, metric: str = "euclidean", strict: bool = True) -> DataFrame:
    """(src, dst, rank, dist), exact. ValueError if some point has fewer than k neighbours."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if strict and points.count() < k + (not include_self):
        raise ValueError("fewer points than neighbours asked for")
    found = search(points, points.select(F.col("id").alias("qid"), "vec"), k, metric, exclude_self=not include_self)
    return found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), "rank", "dist")


def symmetrize(edges: DataFrame) -> DataFrame:
    """The union of edges and reversed edges (src, dst, dist)."""
    return edges.select("src", "dst", "dist").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).dropDuplicates(["src", "dst"])


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def canonical(edges: DataFrame) -> DataFrame:
    """Of edges in both directions the one with src < dst; one-way edges and self loops stay."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_both"))
    return edges.join(back, ["src", "dst"], "left").where("src <= dst or _both is null").drop("_both")


def mirror(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Results of canonical edges, and of their reverses that are in edges."""
    turned = results.withColumns({"src": F.col("dst"), "dst": F.col("src")}).join(edges.select("src", "dst"), ["src", "dst"], "left_semi").where("src > dst")
    return results.unionByName(turned)


def weight_statistics(edges: DataFrame, weight: str = "dist") -> DataFrame:
    w = F.col(weight)
    return edges.agg(F.min(w).alias("min_weight"), F.max(w).alias("max_weight"), F.avg(w).alias("mean_weight"), F.sum(w).alias("total_weight"), F.count(w).alias("n_edges"))


def adjacency(edges: DataFrame, name: str = "nbrs") -> DataFrame:
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias(name))


def with_neighbourhoods(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """edges with nx and ny, the neighbour arrays of both ends (empty where there are none)."""
    lists = adjacency(edges if of is None else of)
    empty = F.array().cast("array<long>")
    both = edges.join(lists.withColumnRenamed("nbrs", "_x"), "src", "left").join(lists.select(F.col("src").alias("dst"), F.col("nbrs").alias("_y")), "dst", "left")
    return both.withColumn("nx", F.coalesce("_x", empty)).withColumn("ny", F.coalesce("_y", empty)).drop("_x", "_y")


def jaccard(edges: DataFrame) -> DataFrame:
    both = with_neighbourhoods(edges.select("src", "dst"))
    union = F.size(F.array_union("nx", "ny"))
    return both.select("src", "dst", F.when(union > 0, F.size(F.array_intersect("nx", "ny")) / union).otherwise(0.0).alias("jaccard"))


def gabriel(edges: DataFrame, points: DataFrame) -> DataFrame:
    """(src, dst, gabriel) for a nearest-neighbour graph with rank: false if a third point lies strictly inside the sphere on the
    edge. Such a point is nearer to src than dst is, so it is in src's own list before dst: an equal join on src is enough."""
    x = points.select(F.col("id").alias("src"), F.col("vec").alias("x"))
    y = points.select(F.col("id").alias("dst"), F.col("vec").alias("y"))
    full = edges.select("src", "dst", "rank").join(x, "src").join(y, "dst")
    other = full.select("src", F.col("dst").alias("third"), F.col("rank").alias("rank_z"), F.col("y").alias("z"))
    inside = F.aggregate(F.zip_with(F.zip_with("z", "x", lambda a, b: a - b), F.zip_with("z", "y", lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) < 0
    blocked = full.join(other, "src").where("rank_z < rank").where(inside).select("src", "dst").distinct().withColumn("_blocked", F.lit(True))
    return edges.select("src", "dst").join(blocked, ["src", "dst"], "left").select("src", "dst", F.col("_blocked").isNull().alias("gabriel"))


def local_zscores(scores: DataFrame, score: str = "score") -> DataFrame:
    """(src, dst, z): by the source's median and scaled median deviation; sources with one score, or no deviation, drop out."""
    middle = scores.groupBy("src").agg(F.percentile(score, 0.5).alias("_m"), F.count(score).alias("_n")).where("_n > 1")
    moved = scores.join(middle, "src").withColumn("_d", F.abs(F.col(score) - F.col("_m")))
    spread = moved.groupBy("src").agg(F.percentile("_d", 0.5).alias("_mad")).where("_mad >= 1e-12")
    return moved.join(spread, "src").select("src", "dst", ((F.col(score) - F.col("_m")) / (1.4826 * F.col("_mad"))).alias("z"))


def effective_epsilon(edges: DataFrame, original_k: int, exact: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """(src, dst, eps) of all edges, or of pairs (src, dst): the greater of both ends' mean of nearest neighbour distances. By default the other end is left out and the
    nearest original_k count; exact counts all and drops the nearest, where there are two. An end without any counts as 0."""
    asked = (edges if pairs is None else pairs).select("src", "dst")
    # Only a node's first neighbours count, so its list is cut before it meets its edges; nodes of many edges stay one short row.
    order = Window.partitionBy("src").orderBy("dist", "dst")
    ranked = edges.select("src", "dst", "dist").withColumn("r", F.row_number().over(order)).where(F.col("r") <= original_k + 1)
    lists = ranked.groupBy(F.col("src").alias("at")).agg(F.array_sort(F.collect_list(F.struct("r", "dst", "dist"))).alias("near"))

    def mean_at(df: DataFrame, end: str, other: str, name: str) -> DataFrame:
        near = F.col("near")
        if exact:
            kept = F.when(F.size(near) < 2, near).otherwise(F.slice(near, 2, original_k))
        else:
            kept = F.slice(F.filter(near, lambda s: s["dst"] != F.col(other)), 1, original_k)
        mean = F.try_divide(F.aggregate(kept, F.lit(0.0), lambda t, s: t + s["dist"]), F.size(kept))
        return df.join(lists.withColumnRenamed("at", end), end, "left").select(*df.columns, mean.alias(name))

    both = mean_at(mean_at(asked, "src", "dst", "_a"), "dst", "src", "_b")
    return both.select("src", "dst", F.coalesce(F.greatest("_a", "_b"), F.lit(0.0)).alias("eps"))


def filter_graph(scores: DataFrame, threshold: float = 0.0, min_neighbors: int = 1) -> DataFrame:
    """Of each source's edges (src, dst, kappa) those at or over the threshold, and at least the first min_neighbors."""
    order = Window.partitionBy("src").orderBy(F.desc("kappa"), "dst")
    return scores.withColumn("rn", F.row_number().over(order)).where((F.col("kappa") >= threshold) | (F.col("rn") <= min_neighbors))


def score_statistics(scores: DataFrame, score: str = "kappa") -> DataFrame:
    """Mean, population deviation, least, greatest, median and counts by sign; NaN without rows."""
    k = F.col(score)
    nan = lambda c: F.coalesce(c, F.lit(float("nan")))
    return scores.agg(nan(F.avg(k)).alias("mean"), nan(F.stddev_pop(k)).alias("std"), nan(F.min(k)).alias("min"), nan(F.max(k)).alias("max"), nan(F.percentile(k, 0.5)).alias("median"), F.count_if(k > 0).alias("n_positive"), F.count_if(k < 0).alias("n_negative"))


def with_metadata(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """nodes (id, ...) with the columns of metadata (id, ...); ValueError unless each node has exactly one row of it."""
    ids = nodes.select("id").distinct()
    if metadata.count() != ids.count() or not ids.join(metadata, "id", "left_anti").isEmpty():
        raise ValueError("metadata needs one row for each node")
    return nodes.join(metadata, "id")


def has_metadata(nodes: DataFrame, own: tuple[str, ...] = ("id",)) -> bool:
    return any(c not in own for c in nodes.columns)


def node_neighbors(edges: DataFrame, nodes: DataFrame, weight: str = "dist") -> DataFrame:
    """(id, neighbors, weights) of nodes (column id), in order of weight, then of id; empty lists for nodes without edges."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(weight).alias("w"), F.col("dst").alias("n")))).alias("e"))
    empty = F.array().cast("array<struct<w: double, n: long>>")
    return nodes.select("id").join(lists, "id", "left").withColumn("e", F.coalesce("e", empty)).select("id", F.col("e.n").alias("neighbors"), F.col("e.w").alias("weights"))


def edge_weight(edges: DataFrame, pairs: DataFrame, weight: str = "dist") -> DataFrame:
    """(src, dst, weight) of pairs; null where there is no edge."""
    return pairs.select("src", "dst").join(edges.groupBy("src", "dst").agg(F.min(weight).alias("weight")), ["src", "dst"], "left")


def passes_threshold(kappa: Column, threshold: float) -> Column:
    return kappa >= threshold


def is_positive(kappa: Column) -> Column:
    return kappa > 0
