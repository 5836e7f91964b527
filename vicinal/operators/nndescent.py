"""NN-descent as a relational loop: neighbours of neighbours by a join on the pivot, scored, merged and cut by a window."""
from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import aligned, distance, gemm_sqeuclidean, pairwise
from .knn import Searchable, cell_best, check_dimensions, expand, sites, vectors
from .knn import search as exact
from .trees import LEAF_ROWS, SAMPLE, SAMPLED, Forest, Tree, max_leaf_size, two_points


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the session names."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def cut_plain(df: DataFrame) -> DataFrame:
    """cut, for loops of many rounds: without what the planner has inferred of the rows, which a checkpoint keeps and every round would multiply."""
    held, session = cut(df), df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(held._jdf.toJavaRDD(), held._jdf.schema()), session)


@dataclass(frozen=True)
class Sampling:
    """Keeps a seeded share of the joined pairs."""

    rate: float = 1.0


def score(pairs: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    a, b = points.select(F.col("id").alias("src"), F.col("vec").alias("_a")), points.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", distance("_a", "_b", metric).alias("dist"))


def nearest(edges: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("src").orderBy("dist", "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Points of a random order that starting neighbours are taken from.
GROUP = 8192
#: Pivots whose neighbours meet in one task; fewer where there are not HOMES tasks of them.
PIVOTS, FEW_PIVOTS, HOMES = 8192, 512, 18
#: Trees whose leaves lists start from, most points of such a leaf, and how many leaves a tree has at least, if they aren't smaller than two lists.
START_TREES, START_LEAF, START_LEAVES = 12, 4096, 32
#: A share of new entries that further rounds don't add much to.
LITTLE = 0.1
#: Trees whose leaves a search starts from.
STARTS = 8
#: Points whose pairs with queries meet in one task; fewer where there are not FEW_BLOCKS tasks of them.
BLOCK, FEW_BLOCKS = 8192, 12


def build(points: DataFrame, k: int = 15, rounds: int = 10, init: str = "random", sampling: Sampling | None = None, metric: str = "sqeuclidean", threshold: float = 1e-3, seed: int = 0, symmetry: str = "full", recall: float | None = 0.93) -> DataFrame:
    """An approximate k-nearest-neighbour graph (src, dst, dist, rank). symmetry: full adds all reversed edges, pruned at most half
    as many again as k, none leaves k nearest; continuous adds reversed edges after each round, so that later rounds start from them.
    With a recall, the lists of SAMPLED points are compared with brute force, and the descent goes on with lists of twice the length until they reach it (not without rounds).
    Of equal vectors the one of least id takes part; the others hang on it by edges both ways of length 0, after the k of the graph, so that no list is full of copies."""
    check_dimensions(points)
    points, copied = sites(points.select(F.col("id").cast("long").alias("id"), "vec"))
    points, copied = cut(points), cut(copied)
    graph = _build(points, k, rounds, init, sampling, metric, threshold, seed, symmetry, recall)
    hung = copied.where("id <> site").select(F.explode(F.array(F.struct(F.col("site").alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), F.col("site").alias("dst")))).alias("e"))
    return graph.union(hung.select("e.src", "e.dst", F.lit(0.0), F.lit(k + 1)))


def _build(points: DataFrame, k: int, rounds: int, init: str, sampling: Sampling | None, metric: str, threshold: float, seed: int, symmetry: str, recall: float | None) -> DataFrame:
    n, wide, graph = points.count(), k, None
    some = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLED).select("id", "vec").toArrow().to_pylist() if recall is not None and min(k, rounds, n - 1) > 0 else []
    tried = points.sparkSession.createDataFrame([(r["id"], r["vec"]) for r in some], "qid long, vec array<double>")
    truth = {(r["qid"], r["id"]) for r in exact(points, tried, k, metric, exclude_self=True).collect()} if some else set()

    def reached(graph: DataFrame) -> bool:
        held = graph.join(F.broadcast(tried.select(F.col("qid").alias("src"))), "src").where(F.col("rank") <= k).select("src", "dst").collect()
        return len(truth & {(r["src"], r["dst"]) for r in held}) >= recall * len(truth)

    while True:
        grown = 0 if graph is None else START_TREES * (wide // 2) // k
        start = _starts(points, n, wide, init, seed, metric, k, grown, max(1, START_TREES * wide // k - grown))
        if graph is not None:
            start = start.union(graph.select("src", "dst", "dist")).dropDuplicates(["src", "dst"])
        graph, enough = _descend(start, points, n, wide, rounds, sampling, metric, threshold, symmetry, reached if truth else None, graph is not None)
        if enough or wide >= n - 1:
            break
        wide = min(2 * wide, n - 1)
    graph = graph.where(F.col("rank") <= k).select("src", "dst", "dist", "rank")
    return graph if symmetry == "none" else symmetrized(graph, k if symmetry == "pruned" else None)


def _starts(points: DataFrame, n: int, k: int, init: str, seed: int, metric: str, wanted: int, grown: int, n_trees: int) -> DataFrame:
    """Pairs (src, dst, dist) that lists of k neighbours start from; of a leaf the `wanted` nearest, in n_trees more trees than those grown before."""
    if init == "rptree":
        return _met_in_leaves(points, n, wanted, seed + 1000 * grown, metric, n_trees)
    # Successors in k seeded orders, so that every point has k random starting neighbours. An order holds about GROUP points, dealt anew for each.
    groups = max(1, -(-n // GROUP))
    turns = points.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("t"))
    shuffled = turns.select("id", "t", F.pmod(F.xxhash64("id", F.col("t") + (seed + 1)), F.lit(groups)).alias("g"), F.xxhash64("id", -F.col("t") - (seed + 1)).alias("h"))
    order = Window.partitionBy("t", "g").orderBy("h", "id")
    start = shuffled.select(F.col("id").alias("src"), F.lead("id").over(order).alias("dst")).where("dst is not null")
    return score(start.union(start.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).dropDuplicates(), points, metric)


def _met_in_leaves(points: DataFrame, n: int, k: int, seed: int, metric: str, n_trees: int) -> DataFrame:
    """(src, dst, dist): the k nearest of all that share a leaf of a tree with src. A leaf is met in one task, as products of blocks, and lists leave it as arrays."""
    size = max(2 * k, min(START_LEAF, n // START_LEAVES))
    # What was cut may lie in one partition, since its bytes are few.
    spread = points.repartition(max(1, min(-(-n // FEW_PIVOTS), 48 + n // GROUP)), "id")
    forest = Forest.build(spread, stop=max_leaf_size(size), n_trees=n_trees, seed=seed, metric=metric)
    # No leaf holds more of the sample than `size`; more than LEAF_ROWS points are dealt into parts.
    parts = max(1, -(-n * size // min(n, SAMPLE) // LEAF_ROWS))
    homes = max(1, min(parts * sum(t.leaves for t in forest.trees), -(-n * n_trees // GROUP), 4000))
    dealt = forest.leaves.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).repartition(homes, "tree", "leaf", "part")

    def meet(key, rows):
        ids = rows.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")  # so that a lost leaf grows the same tree again
        ids, x = ids[by], vectors(rows.column("vec"))[by]
        inner = Tree.grow(x, two_points, max_leaf_size(size), seed + 1000 * key[0].as_py() + 1).route(x)
        src, dst, dist = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for leaf in np.unique(inner):
            own = inner == leaf
            found = cell_best(x[own], ids[own], x[own], ids[own], k, True, metric=metric)
            for to, column in zip((src, dst, dist), found.columns, strict=True):
                to.append(column.to_numpy())
        src, dst, dist = map(np.concatenate, (src, dst, dist))
        first = np.flatnonzero(np.diff(src, prepend=src[:1] - 1))  # one src after another
        ends = pa.array(np.append(first, len(src)), pa.int32())
        return pa.table({"src": pa.array(src[first], pa.int64()), "dsts": pa.ListArray.from_arrays(ends, pa.array(dst)), "dists": pa.ListArray.from_arrays(ends, pa.array(dist))})

    def merge(key, rows):
        dsts, dists = rows.column("dsts").combine_chunks(), rows.column("dists").combine_chunks()
        src, dst, dist = np.repeat(rows.column("src").to_numpy(), dsts.value_lengths().to_numpy()), dsts.flatten().to_numpy(), dists.flatten().to_numpy()
        by = np.lexsort((dst, dist, src))
        src, dst, dist = src[by], dst[by], dist[by]
        new = np.append(True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1]))[: len(src)]  # what shares several leaves
        src, dst, dist = src[new], dst[new], dist[new]
        keep = np.arange(len(src)) - np.searchsorted(src, src) < k
        return pa.table({"src": pa.array(src[keep], pa.int64()), "dst": pa.array(dst[keep], pa.int64()), "dist": pa.array(dist[keep], pa.float64())})

    met = dealt.groupBy("tree", "leaf", "part").applyInArrow(meet, "src long, dsts array<long>, dists array<double>")
    buckets = max(1, -(-n * k * n_trees // 2_000_000))
    return met.withColumn("bucket", F.pmod(F.xxhash64("src"), F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, "src long, dst long, dist double")


def _descend(start: DataFrame, points: DataFrame, n: int, k: int, rounds: int, sampling: Sampling | None, metric: str, threshold: float, symmetry: str, reached: Callable[[DataFrame], bool] | None, widened: bool) -> tuple[DataFrame, bool]:
    """(src, dst, dist, rank, fresh): lists of k neighbours, from pairs (src, dst, dist) and after rounds of joins on pivots; and whether they are enough.
    Where rounds add little and lists aren't enough, longer ones are due; widened lists need no more rounds once they are enough."""
    graph = cut_plain(nearest(start, k).select("src", "dst", "dist", "rank").withColumn("fresh", F.lit(True)))
    enough = reached is None or widened and reached(graph)
    for r in range(0 if widened and enough else rounds):
        cap = -(-3 * k // 2)
        back = graph.select(F.col("dst").alias("pivot"), F.col("src").alias("x"), "fresh", "dist").withColumn("r", F.row_number().over(Window.partitionBy("pivot").orderBy(F.xxhash64("x", F.lit(r)), "x"))).where(F.col("r") <= cap)
        meets = graph.select(F.col("src").alias("pivot"), F.col("dst").alias("x"), "fresh").union(back.select("pivot", "x", "fresh")).groupBy("pivot", "x").agg(F.max("fresh").alias("fresh"))
        better = nearer_pairs(meets, graph, points, n, k, metric, sampling, r).withColumn("fresh", F.lit(True))
        if symmetry == "continuous":
            better = better.union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", F.lit(True).alias("fresh")))
        merged = graph.select("src", "dst", "dist", F.lit(False).alias("fresh")).union(better).groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
        graph = cut_plain(nearest(merged, k).select("src", "dst", "dist", "rank", "fresh"))
        fresh = graph.where("fresh").count()
        if reached is not None and (widened or fresh < LITTLE * n * k):
            enough = reached(graph)
        if fresh < threshold * n * k or reached is not None and (enough and widened or not enough and fresh < LITTLE * n * k):
            break
    return graph, enough or reached(graph)


def nearer_pairs(meets: DataFrame, graph: DataFrame, points: DataFrame, n: int, k: int, metric: str, sampling: Sampling | None, turn: int) -> DataFrame:
    """(src, dst, dist) both ways of all pairs that share a pivot in meets (pivot, x, fresh), one of them fresh, as far as they are nearer than the last of src's k in graph.
    About PIVOTS pivots meet in one task, which holds each of their vectors once and of a src's pairs lets the k nearest leave."""
    homes = max(1, -(-n // PIVOTS), min(HOMES, -(-n // FEW_PIVOTS)))
    home = F.pmod(F.xxhash64("pivot"), F.lit(homes))
    lists = meets.groupBy("pivot").agg(F.collect_list("x").alias("xs"), F.collect_list("fresh").alias("fs")).select(home.alias("home"), "pivot", "xs", "fs")
    last = graph.groupBy("src").agg(F.count("*").alias("_n"), F.max("dist").alias("_last"))
    reach = points.join(last, points["id"] == last["src"], "left").select("id", "vec", F.when(F.col("_n") >= k, F.col("_last")).otherwise(F.lit(float("inf"))).alias("reach"))
    members = meets.select(home.alias("home"), F.col("x").alias("id")).distinct().join(reach, "id")
    rate = 1.0 if sampling is None else sampling.rate
    by_products = metric in ("euclidean", "sqeuclidean")

    def meet(key, left, right):
        by = np.argsort(right.column("id").to_numpy(), kind="stable")
        ids, x, last = right.column("id").to_numpy()[by], vectors(right.column("vec"))[by], right.column("reach").to_numpy()[by]
        xs, fs = left.column("xs").combine_chunks(), left.column("fs").combine_chunks()
        flat, fresh, ends = np.searchsorted(ids, xs.flatten().to_numpy()), fs.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(xs.value_lengths().to_numpy())])
        # Squared lengths by products only leave out what cannot be near enough, with room for rounding.
        far = last**2 if metric == "euclidean" else last
        room = far * (1 + 1e-9) + 1e-9 * (1 + (x * x).sum(axis=1)) if by_products else far
        found, held = [np.zeros(0, np.int64)], 0
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own, new = flat[a:b], fresh[a:b]
            if new.any():
                d = gemm_sqeuclidean(x[own], x[own]) if by_products else pairwise(x[own], x[own], metric)
                i, j = np.nonzero((d <= room[own][:, None]) & (new[:, None] | new[None, :]) & (own[:, None] != own[None, :]))
                found.append(own[i] * len(ids) + own[j])
                held += len(i)
                if held > 4_000_000:  # what several pivots share is held once
                    found = [np.unique(np.concatenate(found))]
                    held = 0
        pairs = np.unique(np.concatenate(found))
        i, j = pairs // max(1, len(ids)), pairs % max(1, len(ids))
        if rate < 1:
            keep = _drawn(np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), turn) < rate
            i, j = i[keep], j[keep]
        dist = np.concatenate([np.zeros(0), *(aligned(x[i[s : s + 65_536]], x[j[s : s + 65_536]], metric) for s in range(0, len(i), 65_536))])
        keep = dist <= last[i]
        i, j, dist = i[keep], j[keep], dist[keep]
        by = np.lexsort((ids[j], dist, i))
        i, j, dist = i[by], j[by], dist[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pa.table({"src": pa.array(ids[i[keep]], pa.int64()), "dst": pa.array(ids[j[keep]], pa.int64()), "dist": pa.array(dist[keep], pa.float64())})

    # Numbered partitions, since tasks of few bytes and many products would be run as one.
    return lists.repartition(homes, "home").groupBy("home").cogroup(members.repartition(homes, "home").groupBy("home")).applyInArrow(meet, "src long, dst long, dist double")


def _drawn(a: np.ndarray, b: np.ndarray, turn: int) -> np.ndarray:
    """A seeded draw from 0 to 1 for each pair."""
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(turn + 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return (h ^ (h >> np.uint64(31))) / 2.0**64


def symmetrized(graph: DataFrame, k: int | None = None, strict_reference: bool = False) -> DataFrame:
    """With reversed edges; with a k, at most 1.5 k (strict_reference: k) nearest for each source."""
    both = graph.select("src", "dst", "dist").union(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")).dropDuplicates(["src", "dst"])
    return nearest(both, (1 << 30) if k is None else k if strict_reference else 3 * k // 2)


def search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int, hops: int = 6, entries: int = 16, beam: int = 32, seed: int = 0, metric: str = "sqeuclidean", recall: float | None = None) -> DataFrame:
    """Best-first search of all queries at once: from seeded entry points and the leaves of STARTS trees, the neighbours of the best `beam` are scored hop after hop.
    The graph may fall apart, as that of points on lines does; the trees lead into all of its parts. Equal vectors are one until the end.
    With a recall, the answers to SAMPLED queries are compared with brute force, and the beam is doubled until they reach it."""
    check_dimensions(points, queries)
    points, copied = sites(points.select(F.col("id").cast("long").alias("id"), "vec"))
    points, copied = cut(points), cut(copied)
    at = copied.where("id <> site")
    for end in ("src", "dst"):
        graph = graph.join(at.select(F.col("id").alias(end), "site"), end, "left").withColumn(end, F.coalesce("site", end)).drop("site")
    lists = cut(graph.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("near")))
    entry = points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(entries).select("id")
    ids = [r["id"] for r in entry.collect()]  # `entries` ids
    led = Forest.build(points, stop=max_leaf_size(2 * beam), n_trees=STARTS, seed=seed).search(queries, beam, recall=None)
    start = cut(queries.select("qid", F.explode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("id")).union(led.select("qid", "id")))
    n = points.count()
    if recall is not None and k > 0:
        beam = _wide_enough(lists, points, n, queries, start, k, hops, beam, seed, metric, recall)
    return expand(_walk(lists, points, n, queries, start, hops, beam, metric).where(F.col("rank") <= k), copied, k)


def _wide_enough(lists: DataFrame, points: DataFrame, n: int, queries: DataFrame, start: DataFrame, k: int, hops: int, beam: int, seed: int, metric: str, recall: float) -> int:
    """beam, or twice, four times as much and so on; a wider walk starts from where the narrower one ended."""
    some = queries.orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(SAMPLED).select("qid", "vec").toArrow().to_pylist()
    tried = points.sparkSession.createDataFrame([(r["qid"], r["vec"]) for r in some], "qid long, vec array<double>")
    truth = {(r["qid"], r["id"]) for r in exact(points, tried, k, metric).collect()}
    start = start.join(F.broadcast(tried.select("qid")), "qid", "left_semi")
    while beam < n:
        start = _walk(lists, points, n, tried, start.select("qid", "id"), hops, beam, metric)
        if len(truth & {(r["qid"], r["id"]) for r in start.where(F.col("rank") <= k).collect()}) >= recall * len(truth):
            break
        beam *= 2
    return beam


def _walk(lists: DataFrame, points: DataFrame, n: int, queries: DataFrame, start: DataFrame, hops: int, beam: int, metric: str) -> DataFrame:
    """(qid, id, dist, fresh, rank): the `beam` nearest that are found from start (qid, id) by following lists (id, near); fresh are those whose own lists were not read."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    held = lambda df: cut_plain(df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= beam))
    queries = queries.select(F.col("qid").cast("long").alias("qid"), "vec")
    seen = held(_scored(start, points, n, queries.withColumn("reach", F.lit(float("inf"))), beam, metric).withColumn("fresh", F.lit(True)))
    for _ in range(hops):
        last = seen.groupBy("qid").agg(F.count("*").alias("_n"), F.max("dist").alias("_last"))
        reach = queries.join(last, "qid", "left").select("qid", "vec", F.when(F.col("_n") >= beam, F.col("_last")).otherwise(F.lit(float("inf"))).alias("reach"))
        further = seen.where("fresh").select("qid", "id").join(lists, "id").select("qid", F.explode("near").alias("id"))
        found = _scored(further, points, n, reach, beam, metric).withColumn("fresh", F.lit(True))
        both = seen.select("qid", "id", "dist", F.lit(False).alias("fresh")).union(found).repartition("qid")  # dealt once for the groups and the window
        seen = held(both.groupBy("qid", "id").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh")))
        if seen.where("fresh").isEmpty():
            break
    return seen


def _scored(pairs: DataFrame, points: DataFrame, n: int, asks: DataFrame, beam: int, metric: str) -> DataFrame:
    """(qid, id, dist) of the distinct pairs (qid, id), as far as they are within reach of asks (qid, vec, reach). About BLOCK points meet all pairs with them in one task,
    which holds each vector once and lets the `beam` nearest of a query leave."""
    blocks = max(1, -(-n // BLOCK), min(FEW_BLOCKS, -(-n // FEW_PIVOTS)))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    sides = points.select(block, "id", "vec", F.lit(None).cast("double").alias("reach")).union(asks.select(every, F.col("qid").alias("id"), "vec", "reach"))
    by_products = metric in ("euclidean", "sqeuclidean")

    def meet(key, left, right):
        asking = ~np.isnan(right.column("reach").to_numpy())
        (ids, x, _), (qid, q, reach) = (_by_id(right.filter(pa.array(own))) for own in (~asking, asking))
        out = []
        if len(ids) and len(qid) and left.num_rows:
            i, at = left.column("id").to_numpy(), left.column("qid").to_numpy()
            place, asked = np.minimum(np.searchsorted(ids, i), len(ids) - 1), np.minimum(np.searchsorted(qid, at), len(qid) - 1)
            known = (ids[place] == i) & (qid[asked] == at)
            pairs = np.unique(asked[known] * len(ids) + place[known])
            # Squared lengths by products only leave out what cannot be near enough, with room for rounding.
            far = reach**2 if metric == "euclidean" else reach
            long_x, long_q = (x * x).sum(axis=1), (q * q).sum(axis=1)
            room = far * (1 + 1e-9) + 1e-9 * (1 + long_q)
            for a in range(0, len(pairs), 65_536):
                at, i = np.divmod(pairs[a : a + 65_536], len(ids))
                if by_products:
                    keep = long_x[i] + long_q[at] - 2 * np.einsum("ij,ij->i", x[i], q[at]) <= room[at] + 1e-9 * long_x[i]
                    at, i = at[keep], i[keep]
                dist = aligned(q[at], x[i], metric)
                keep = dist <= reach[at]
                out.append((at[keep], i[keep], dist[keep]))
        at, i, dist = map(np.concatenate, zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        by = np.lexsort((i, dist, at))
        at, i, dist = at[by], i[by], dist[by]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < beam
        return pa.table({"qid": pa.array(qid[at[keep]], pa.int64()), "id": pa.array(ids[i[keep]], pa.int64()), "dist": pa.array(dist[keep], pa.float64())})

    # Numbered partitions, as in nearer_pairs.
    return pairs.select("qid", "id", block).repartition(blocks, "block").groupBy("block").cogroup(sides.repartition(blocks, "block").groupBy("block")).applyInArrow(meet, "qid long, id long, dist double")


def _by_id(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors and reach of rows in order of id."""
    ids = rows.column("id").to_numpy()
    by = np.argsort(ids, kind="stable")
    return ids[by], vectors(rows.column("vec"))[by], rows.column("reach").to_numpy()[by]


@dataclass
class NnDescentIndex(Searchable):
    """A neighbour graph with its points, searched best first."""

    graph: DataFrame
    points: DataFrame
    k: int
    metric: str = "sqeuclidean"
    metadata = True

    @classmethod
    def build(cls, points: DataFrame, k: int = 15, rounds: int = 10, metric: str = "sqeuclidean", **options) -> NnDescentIndex:
        return cls(build(points, k, rounds, metric=metric, **options), points, k, metric)

    def search(self, queries: DataFrame, k: int, beam: int = 32, recall: float | None = None) -> DataFrame:
        return search(self.graph, self.points, queries, k, beam=beam, metric=self.metric, recall=recall)

    def edges(self) -> DataFrame:
        """The graph itself (src, dst, dist, rank)."""
        return self.graph

    def configured_k(self) -> int:
        return self.k
