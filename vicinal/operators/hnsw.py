"""Layered navigable graphs, one for each shard of points; the shards' answers merge by top k.

A shard is built in one task from a bounded number of points (SHARD), in order of id, with levels drawn from the seed and the id,
so that a rebuilt shard is equal to the lost one.
"""
from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import Searchable, check_dimensions, expand, sites, stream, top_k, vectors
from .nndescent import cut

#: Expected points of a shard.
SHARD = 20_000
#: Queries that meet a part at once.
QUERIES = 16_384
#: Queries that a wanted recall is measured on.
TRIED = 64
#: Most partitions that parts are dealt to.
HOMES = 2000
#: Points of a box that a check reads as one.
BOX = 64


def closest(ids: list[tuple[float, int]], m: int, between) -> list[tuple[float, int]]:
    return sorted(ids)[:m]


def diversified(ids: list[tuple[float, int]], m: int, between) -> list[tuple[float, int]]:
    """Skips what is nearer to a chosen neighbour than to the point itself; refills from the skipped."""
    chosen, skipped = [], []
    for d, i in sorted(ids):
        if len(chosen) == m:
            break
        (skipped if chosen and min(between(i, [j for _, j in chosen])) < d else chosen).append((d, i))
    return chosen + skipped[: m - len(chosen)]


@dataclass
class Params:
    m: int = 16
    ef_construction: int = 200
    ef: int = 64
    policy: str = "diversified"
    seed: int = 0
    metric: str = "euclidean"


class Graph:
    def __init__(self, params: Params, dims: int):
        self.p, self.x, self.ids, self.links, self.top = params, np.zeros((0, dims)), [], [], (-1, -1)
        self.choose = diversified if params.policy == "diversified" else closest
        self.scale = 1 / np.log(max(params.m, 2))

    def level(self, key: int) -> int:
        u = np.random.default_rng([self.p.seed, key & 0x7FFFFFFF]).random()
        return int(-np.log(max(u, 1e-12)) * self.scale)

    def far(self, q: np.ndarray, at: list[int]) -> np.ndarray:
        y = self.x[at]
        if self.p.metric == "cosine":
            n = np.linalg.norm(y, axis=1) * np.linalg.norm(q)
            return 1 - np.divide(y @ q, n, out=np.zeros(len(at)), where=n > 0)
        d = ((y - q) ** 2).sum(axis=1)
        return np.sqrt(d) if self.p.metric == "euclidean" else d

    def beam(self, q: np.ndarray, start: list[tuple[float, int]], level: int, ef: int) -> list[tuple[float, int]]:
        todo, best, seen = list(start), [(-d, -i) for d, i in start], {i for _, i in start}
        heapq.heapify(todo)
        heapq.heapify(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= ef and d > -best[0][0]:
                break
            fresh = [j for j in self.links[i][level] if j not in seen]
            seen.update(fresh)
            if fresh:
                for e, j in zip(self.far(q, fresh).tolist(), fresh, strict=True):
                    if len(best) < ef or (e, j) < (-best[0][0], -best[0][1]):
                        heapq.heappush(todo, (e, j))
                        heapq.heappush(best, (-e, -j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def insert(self, key: int, v: np.ndarray) -> None:
        level, at = self.level(key), len(self.ids)
        self.x = np.vstack([self.x, v]) if at == len(self.x) else self.x
        self.ids.append(key)
        self.links.append([[] for _ in range(level + 1)])
        top, entry = self.top
        if entry < 0:
            self.top = (level, at)
            return
        near = [(float(self.far(v, [entry])[0]), entry)]
        for lv in range(top, level, -1):
            near = self.beam(v, near[:1], lv, 1)
        for lv in range(min(level, top), -1, -1):
            near = self.beam(v, near, lv, self.p.ef_construction)
            limit = 2 * self.p.m if lv == 0 else self.p.m
            between = lambda i, others: self.far(self.x[i], others)
            for _, j in self.choose(near, self.p.m, between):
                self.links[at][lv].append(j)
                self.links[j][lv].append(at)
                if len(self.links[j][lv]) > limit:
                    own = self.links[j][lv]
                    self.links[j][lv] = [i for _, i in self.choose(list(zip(self.far(self.x[j], own).tolist(), own, strict=True)), limit, between)]
        if level > top:
            self.top = (level, at)

    def search(self, q: np.ndarray, k: int, ef: int | None = None) -> list[tuple[float, int]]:
        top, entry = self.top
        if entry < 0 or k <= 0:
            return []
        near = [(float(self.far(q, [entry])[0]), entry)]
        for lv in range(top, 0, -1):
            near = self.beam(q, near[:1], lv, 1)
        return [(d, self.ids[i]) for d, i in self.beam(q, near, 0, max(k, ef or self.p.ef))][:k]

    def scan(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """What search finds where it misses nothing."""
        d, ids = self.far(q, list(range(len(self.ids)))), np.array(self.ids)
        return [(float(d[i]), int(ids[i])) for i in np.lexsort((ids, d))[:k].tolist()]

    def boxes(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Groups of at most BOX points that lie together, and the least and greatest values of each."""
        todo, groups = [np.arange(len(self.ids))] if self.ids else [], []
        while todo:
            own = todo.pop()
            if len(own) <= BOX:
                groups.append(own)
                continue
            x = self.x[own]
            by = own[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
            todo += [by[: len(by) // 2], by[len(by) // 2 :]]
        low, high = (np.array([f(self.x[own], axis=0) for own in groups]).reshape(len(groups), self.x.shape[1]) for f in (np.min, np.max))
        return groups, low, high

    def checked(self, q: np.ndarray, k: int, found: list[tuple[float, int]], boxes: tuple[list[np.ndarray], np.ndarray, np.ndarray]) -> list[tuple[float, int]]:
        """What scan finds, from what search has found: points of all boxes that aren't farther than the last of k are compared."""
        groups, low, high = boxes
        bound = (np.maximum(np.maximum(low - q, q - high), 0.0) ** 2).sum(axis=1)
        reach = found[k - 1][0] if len(found) >= k else np.inf
        near = np.flatnonzero(~((np.sqrt(bound) if self.p.metric == "euclidean" else bound) > reach * (1 + 1e-12))).tolist()
        at = np.concatenate([np.zeros(0, np.int64), *(groups[g] for g in near)])
        d, ids = self.far(q, at), np.array(self.ids, np.int64)[at]
        return [(float(d[i]), int(ids[i])) for i in np.lexsort((ids, d))[:k].tolist()]


@dataclass
class HnswIndex(Searchable):
    """shards: (shard, part, graph); a shard is a bucket or a hash class, its parts hold about SHARD points each."""

    params: Params
    shards: DataFrame
    #: Points (site, id) of vectors that occur more than once; graphs hold one point of each, the one that is named site.
    copied: DataFrame
    mutable, layered, metadata = True, True, True

    @classmethod
    def build(cls, points: DataFrame, params: Params | None = None, shard: str | None = None) -> HnswIndex:
        """shard names a column that deals points to shards; else all are one. A hash deals a shard's points to parts of about SHARD points."""
        check_dimensions(points)
        params = params or Params()
        own = points.select(F.col("id").cast("long").alias("id"), "vec", (F.col(shard).cast("long") if shard else F.lit(0).cast("long")).alias("shard"))
        own, copied = sites(own, ("shard",))
        sizes = own.groupBy("shard").agg(F.ceil(F.count("*") / SHARD).alias("parts"))
        # Numbered partitions, since parts of few bytes would be built one after another by one task.
        homes = min(4 * (sizes.agg(F.sum("parts")).first()[0] or 1), HOMES)
        dealt = own.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("shard", "part", "id", "vec").repartition(homes, "shard", "part")

        def make(key, rows):
            x, ids = vectors(rows.column("vec")), rows.column("id").to_numpy()
            graph = Graph(params, x.shape[1])
            order = np.argsort(ids, kind="stable")
            graph.x = x[order]
            for k in order:
                graph.insert(int(ids[k]), x[k])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "graph": pa.array([pickle.dumps(graph)], pa.binary())})

        return cls(params, cut(dealt.groupBy("shard", "part").applyInArrow(make, "shard long, part long, graph binary")), cut(copied))

    def configured_k(self) -> int:
        return self.params.m

    def insert(self, more: DataFrame) -> HnswIndex:
        """A new index with more points, in further parts. Ids go on without a gap where the index ends, or a ValueError is raised."""
        last = self.nodes().agg(F.max("id")).first()[0]
        low, high, n, distinct = more.agg(F.min("id"), F.max("id"), F.count("*"), F.count_distinct("id")).first()
        if n and (low != (-1 if last is None else last) + 1 or high - low + 1 != n or n != distinct):
            raise ValueError(f"ids must follow {last} without a gap")
        added = HnswIndex.build(more, self.params)
        first = (self.shards.agg(F.max("part")).first()[0] or 0) + 1
        return HnswIndex(self.params, self.shards.union(added.shards.withColumn("part", F.col("part") + first)), self.copied.union(added.copied))

    def nodes(self) -> DataFrame:
        """(id) of all points."""

        def run(batches):
            for batch in batches:
                for blob in batch.column(2).to_pylist():
                    yield pa.RecordBatch.from_pydict({"id": pa.array(pickle.loads(blob).ids, pa.int64())})

        return stream(self.shards, run, "id long", rows=1).union(self.copied.where("id <> site").select("id"))

    def search(self, queries: DataFrame, k: int, ef: int | None = None, routed: bool = False, recall: float | None = None, check: bool = False) -> DataFrame:
        """All queries in all shards; with routed, queries name their shards in a column `shard`. A stated query set is searched in every part, in blocks of QUERIES.
        With a recall, ef is doubled until the answers to TRIED queries hold that share of what brute force finds in the shards that they ask.
        With check, what a walk finds is an upper bound only: boxes of a part's points that may hold something nearer are read too, so that the answer is exact (in few
        dimensions these are few; in many, nearly all). Links of the closest alone don't lead from line to line where points lie densely on lines, so a walk may end on a wrong one."""
        check_dimensions(queries)
        if check and self.params.metric not in ("euclidean", "sqeuclidean"):
            raise ValueError(f"boxes give no bound for {self.params.metric}")
        if recall is not None and k > 0:
            ef = self.wide_enough(queries, k, ef or self.params.ef, routed, recall)
        return self._ask(queries, k, routed, lambda graph, q: graph.search(q, k, ef), check)

    def wide_enough(self, queries: DataFrame, k: int, ef: int, routed: bool, recall: float) -> int:
        """ef, or twice, four times as much and so on; no more once it is as large as a part."""
        some = [r["qid"] for r in queries.select("qid").distinct().orderBy(F.xxhash64("qid"), "qid").limit(TRIED).collect()]
        tried = queries.where(F.col("qid").isin(some))
        rows = lambda found: {(r["qid"], r["id"]) for r in found.collect()}
        truth = rows(self._ask(tried, k, routed, lambda graph, q: graph.scan(q, k))) if some else set()
        while ef < SHARD and len(truth & rows(self._ask(tried, k, routed, lambda graph, q: graph.search(q, k, ef)))) < recall * len(truth):
            ef *= 2
        return ef

    def _ask(self, queries: DataFrame, k: int, routed: bool, find: Callable[[Graph, np.ndarray], list[tuple[float, int]]], check: bool = False) -> DataFrame:
        """The k best of what find returns for each query and each part of its shards, checked if so wished."""
        places = self.shards.select("shard", "part")
        blocked = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-queries.count() // QUERIES)))))
        if routed:
            asked = blocked.select("qid", "vec", "block", "shard").join(places, "shard")
        else:  # the numbers of all parts, a row for each SHARD points
            numbers = [(r["shard"], r["part"]) for r in places.collect()]
            everywhere = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("shard"), F.lit(p).cast("long").alias("part")) for s, p in numbers])) if numbers else F.lit(None).cast("struct<shard: long, part: long>")
            asked = blocked.select("qid", "vec", "block", everywhere.alias("at")).select("qid", "vec", "block", "at.shard", "at.part")
        wanted = asked.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.col("block").alias("b")).distinct()
        graphs = wanted.join(self.shards.select(F.col("shard").alias("s"), F.col("part").alias("p"), "graph"), ["s", "p"])

        def run(key, left, right):
            out = []
            for blob in right.column("graph").to_pylist():
                graph = pickle.loads(blob)
                boxes = graph.boxes() if check and k > 0 else None
                for qid, q in zip(left.column("qid").to_pylist(), vectors(left.column("vec")), strict=True):
                    found = find(graph, q)
                    out += [(qid, i, d) for d, i in (found if boxes is None else graph.checked(q, k, found, boxes))]
            a, b, c = zip(*out, strict=True) if out else ((), (), ())
            return pa.table({"qid": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "dist": pa.array(c, pa.float64())})

        found = top_k(asked.groupBy("shard", "part", "block").cogroup(graphs.groupBy("s", "p", "b")).applyInArrow(run, "qid long, id long, dist double"), k)
        return expand(found, self.copied, k)

    def edges(self) -> DataFrame:
        """(layer, src, dst) of all shards. A copy hangs on its site, in the lowest layer."""

        def run(batches):
            for batch in batches:
                for blob in batch.column(2).to_pylist():
                    g = pickle.loads(blob)
                    rows = [(lv, g.ids[i], g.ids[j]) for i, levels in enumerate(g.links) for lv, own in enumerate(levels) for j in own]
                    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
                    yield pa.RecordBatch.from_pydict({"layer": pa.array(a, pa.int32()), "src": pa.array(b, pa.int64()), "dst": pa.array(c, pa.int64())})

        hung = self.copied.where("id <> site").select(F.explode(F.array(F.struct(F.col("site").alias("src"), F.col("id").alias("dst")), F.struct(F.col("id").alias("src"), F.col("site").alias("dst")))).alias("e"))
        return stream(self.shards, run, "layer int, src long, dst long", rows=1).union(hung.select(F.lit(0).alias("layer"), "e.src", "e.dst"))
