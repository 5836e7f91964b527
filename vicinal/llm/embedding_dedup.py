"""Embedding near-duplicates by NN-descent.

Equal vectors of a label become one representative. Signs of projections make a signature of SIGNATURE bits; two vectors that can be
linked differ in at most `reach` bits (seven deviations over the mean at the threshold). A neighbour graph of pairs within reach is
started from the leaves of random-hyperplane trees and refined in rounds: what a vector lists, and what lists it, meets at that
vector (the pivot), where all pairs are compared. In a round, the pivots are those that come first among their own neighbours by a
seeded hash, so that a clique meets once. The number of trees grows with the logarithm of a label's size, so that a
pair just at the threshold shares no leaf with a probability of at most MISS. Trees and rounds move ids and signatures, never vectors.

Lists grow while they are saturated, that is hold only entries within reach, up to LONG_LIST entries. A vector whose list is full then,
or that has so many within reach in one leaf, is dense. A pair with a vector that isn't dense stands in that vector's list and
is compared exactly. Pairs of dense vectors are counted in blocks: blocks hold one group each, with a centre and a radius, so that
blocks too far apart for any link fall out, blocks wholly within the threshold are counted without products, and only others are
multiplied. So a dense group costs up to the square of its own size, not of its label's.

Recall is audited: drawn vectors are compared with all others until AUDIT_LINKED of them have links or AUDIT_MOST are drawn. Under
AUDIT_RECALL, further trees are drawn from another seed; after STARTS starts the job fails rather than returning less.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or vec_id, link
with nothing: n_links 0, their own component, kept (kept is null for a null vec_id). Vectors of different sizes are never linked. A
row repeated counts once as a link; rows that repeat a vec_id with other vectors each have the links of their own vector. Ties need no
rule: all that is at the threshold is linked. An empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, groups_of, map_batches, map_stream
from .components import connected_components, local_labels

#: Bits of a signature; the chance that a pair at the threshold shares no leaf; expected vectors of a leaf.
SIGNATURE, MISS, LEAF = 256, 1e-4, 1024
#: Entries of a list at most; a saturated list grows up to it.
LONG_LIST = 64
#: Leaves with more vectors are salted into parts of half as many.
HOT_LEAF = 8192
#: Levels of a tree at most.
DEEPEST = 40
#: Rounds, drawn starts, and what the audit asks for.
ROUNDS, STARTS, AUDIT_FIRST, AUDIT_MOST, AUDIT_LINKED, AUDIT_RECALL = 4, 4, 1024, 8192, 400, 0.97
#: Vectors of a block of dense vectors, blocks of a chunk, and centres compared at once.
BLOCK, CHUNK, CENTRES = 1024, 64, 2048
EDGES = "id long, nbr long, differ int, fresh boolean, dense boolean"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal sizes as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one vector size at a time, with their unit vectors."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes):
        own = np.flatnonzero(sizes == dims)
        yield own, unit(matrix(column.take(pa.array(own)) if len(own) < len(column) else column))


def agreement(threshold: float) -> float:
    """The chance that a random hyperplane has two vectors at the threshold on one side."""
    return 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi


def reach_of(threshold: float) -> int:
    p = 1 - agreement(threshold)
    return int(np.ceil(SIGNATURE * p + 7 * np.sqrt(SIGNATURE * p * (1 - p))))


def trees_of(levels: np.ndarray, threshold: float) -> np.ndarray:
    """Trees for leaves `levels` deep, so that a pair at the threshold misses all of them with a probability of at most MISS."""
    shared = agreement(threshold) ** np.maximum(levels, 1)
    return np.where(levels == 0, 1, np.ceil(np.log(MISS) / np.log1p(-np.minimum(shared, 1 - 1e-9)))).astype(np.int64)


@functools.lru_cache(128)
def planes(dims: int, rows: int, *seed: int) -> np.ndarray:
    """Random directions, at right angles to each other as far as `dims` allows."""
    draws, out = np.random.default_rng([dims, *seed]), []
    while (left := rows - sum(map(len, out))) > 0:
        out.append(np.linalg.qr(draws.standard_normal((dims, min(dims, left))))[0].T)
    return np.concatenate(out)


def sign_bits(x: np.ndarray) -> np.ndarray:
    """Rows of SIGNATURE bits as unsigned 64-bit integers."""
    return np.packbits(x @ planes(x.shape[1], SIGNATURE, 1).T >= 0, axis=1).view(np.uint64)


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SIGNATURE // 64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(SIGNATURE // 64):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def edges_between(*keys: np.ndarray) -> list[int]:
    """Bounds of runs in which no key changes."""
    change = np.zeros(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return [0, *(np.flatnonzero(change) + 1).tolist(), len(keys[0])]


def in_leaf(ids: np.ndarray, bits: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Edges (id, nbr, differ, dense) of a leaf: all within reach; of vectors with LONG_LIST or more within reach only the nearest two, as dense."""
    for a in range(0, len(ids), 256):
        own = slice(a, a + 256)
        apart = differing(bits[own], bits)
        apart[ids[own][:, None] == ids[None, :]] = SIGNATURE + 1
        near = apart <= reach
        dense = near.sum(axis=1) >= LONG_LIST
        if dense.any():
            i = np.flatnonzero(dense)
            for _ in range(2):
                j = apart[i].argmin(axis=1)
                yield ids[own][i], ids[j], apart[i, j], np.ones(len(i), bool)
                apart[i, j] = SIGNATURE + 1
            near[dense] = False
        i, j = np.nonzero(near)
        yield ids[own][i], ids[j], apart[i, j], np.zeros(len(i), bool)


def best(ids: np.ndarray, nbrs: np.ndarray, differ: np.ndarray, fresh: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    """The distinct neighbours of each id, nearest first. All are within reach, so lists are saturated and grow until they have LONG_LIST entries. An id with so
    many, or that is dense by any of its edges, is dense in all, and keeps the nearest two. An edge that was there before isn't fresh."""
    by = np.lexsort((nbrs, ids))
    ids, nbrs, differ, fresh, dense = (x[by] for x in (ids, nbrs, differ, fresh, dense))
    marked = np.unique(ids[dense])
    once = np.ones(len(ids), bool)
    once[1:] = (ids[1:] != ids[:-1]) | (nbrs[1:] != nbrs[:-1])
    old = np.minimum.reduceat(fresh, np.flatnonzero(once)) if len(ids) else fresh
    ids, nbrs, differ = ids[once], nbrs[once], differ[once]
    by = np.lexsort((nbrs, differ, ids))
    ids, nbrs, differ, fresh = ids[by], nbrs[by], differ[by], old[by]
    first = np.array(edges_between(ids))
    rank = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    listed = np.repeat(np.diff(first), np.diff(first))
    dense = np.isin(ids, marked) | (listed >= LONG_LIST)
    keep = ~dense | (rank < 2)
    return pa.RecordBatch.from_pydict({"id": ids[keep], "nbr": nbrs[keep], "differ": differ[keep].astype(np.int32), "fresh": fresh[keep], "dense": dense[keep]})


def edge_arrays(held: pa.Table) -> list[np.ndarray]:
    return [held.column(k).to_numpy() for k in ("id", "nbr", "differ", "fresh", "dense")]


def start(vectors: DataFrame, threshold: float, seed: int, rows: int) -> DataFrame:
    """Edges within reach in the leaves of random-hyperplane trees over vectors (id, p, levels, vec)."""
    reach = reach_of(threshold)

    def leaves(with_bits: bool):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, p, levels = (batch.column(k).to_numpy() for k in range(3))
            trees = trees_of(levels, threshold)
            out: list[tuple] = []
            for own, x in by_size(batch.column(3)):
                bits = sign_bits(x).tobytes() if with_bits else b""
                width = SIGNATURE // 8
                for t in range(int(trees[own].max(initial=0))):
                    some = np.flatnonzero(trees[own] > t)
                    deep = levels[own][some]
                    sides = x[some] @ planes(x.shape[1], DEEPEST, 2, seed, t).T >= 0
                    code = (sides.astype(np.int64) * (np.arange(sides.shape[1])[None] < deep[:, None]) << np.arange(sides.shape[1])[None]).sum(axis=1)
                    out.append((p[own][some], (np.int64(t) << 40) | code, ids[own][some], [bits[width * k : width * (k + 1)] for k in some.tolist()] if with_bits else []))
            columns = [np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3)]
            names = ["p", "leaf", "id"]
            if with_bits:
                return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([b for o in out for b in o[3]], pa.binary())], [*names, "bits"])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        return run

    def compare(batches):
        for held in groups_of(batches, 3):
            p, leaf, salt, ids = (held.column(k).to_numpy() for k in range(4))
            bits, found = signatures(held.column(4).combine_chunks()), []
            bounds = edges_between(p, leaf, salt)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo > 1:
                    found += in_leaf(ids[lo:hi], bits[lo:hi], reach)
            if found:
                a, b, d, dense = (np.concatenate(c) for c in zip(*found, strict=True))
                if len(a):
                    yield best(a, b, d, np.ones(len(a), bool), dense)

    plain = vectors.select("id", "p", "levels", "vec")
    counts = map_batches(plain, leaves(False), "p long, leaf long, id long", rows=4096).groupBy("p", "leaf").count()
    hot = cut(counts.where(F.col("count") > HOT_LEAF).select("p", "leaf", F.ceil(F.col("count") * 2 / HOT_LEAF).alias("salts")))
    dealt = map_batches(plain, leaves(True), "p long, leaf long, id long, bits binary", rows=4096)
    if (n := hot.count()) == 0:
        dealt = dealt.withColumn("salt", F.lit(0).cast("long"))
    else:
        # 24 bytes a hot leaf: broadcast up to 5 MB of them, else joined.
        dealt = dealt.join(F.broadcast(hot) if n <= 200_000 else hot, ["p", "leaf"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id", "leaf"), F.col("salts")), F.lit(0).cast("long")))
    tasks = tasks_for(vectors, rows * 8)
    laid = dealt.select("p", "leaf", "salt", "id", "bits").repartition(tasks, "p", "leaf", "salt").sortWithinPartitions("p", "leaf", "salt")
    return merged(map_stream(laid, compare, EDGES, rows=65_536), tasks_for(vectors, rows))


def tasks_for(df: DataFrame, rows: int) -> int:
    """Shuffle partitions for about a million small rows each, but no fewer than the session's."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 1_000_000))


def merged(edges: DataFrame, tasks: int) -> DataFrame:
    """Lists from any edges."""

    def run(batches):
        for held in groups_of(batches, 1):
            yield best(*edge_arrays(held))

    return cut(map_stream(edges.repartition(tasks, "id").sortWithinPartitions("id"), run, EDGES, rows=65_536))


def signed(vectors: DataFrame) -> DataFrame:
    """id and signature (bits) of every vector."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = [b""] * batch.num_rows
        for own, x in by_size(batch.column(1)):
            for k, row in zip(own.tolist(), sign_bits(x), strict=True):
                out[k] = row.tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bits"])

    return map_batches(vectors.select("id", "vec"), run, "id long, bits binary", rows=4096)


def refine(signs: DataFrame, graph: DataFrame, threshold: float, seed: int, tasks: int) -> DataFrame:
    """One round: all pairs that meet at a pivot and are within reach join the lists."""
    reach = reach_of(threshold)
    listed = graph.where("not dense")
    meets = listed.select(F.col("id").alias("pivot"), F.col("nbr").alias("member"), "differ", "fresh").union(listed.select(F.col("nbr").alias("pivot"), F.col("id").alias("member"), "differ", "fresh"))
    meets = meets.groupBy("pivot", "member").agg(F.min("differ").alias("differ"), F.max("fresh").alias("fresh"))
    # The nearest 2 * LONG_LIST of a pivot; pivots that come first among all that they meet.
    order = Window.partitionBy("pivot").orderBy("differ", "member")
    near = meets.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * LONG_LIST)
    turn = lambda c: F.xxhash64(c, F.lit(seed))
    near = near.withColumn("first", F.min(turn("member")).over(Window.partitionBy("pivot"))).where(turn("pivot") < F.col("first"))
    met = near.select("pivot", "member", "fresh").join(signs.withColumnRenamed("id", "member"), "member").select("pivot", "member", "fresh", "bits").repartition(tasks, "pivot").sortWithinPartitions("pivot")

    def compare(batches):
        for held in groups_of(batches, 1):
            pivot, member, fresh = (held.column(k).to_numpy() for k in range(3))
            sign, found = signatures(held.column(3).combine_chunks()), []
            bounds = edges_between(pivot)
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                apart = differing(sign[lo:hi], sign[lo:hi])
                i, j = np.nonzero((apart <= reach) & (fresh[lo:hi][:, None] | fresh[lo:hi][None, :]) & (member[lo:hi][:, None] != member[lo:hi][None, :]))
                found.append((member[lo:hi][i], member[lo:hi][j], apart[i, j]))
            a, b, d = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(a):
                yield best(a, b, d, np.ones(len(a), bool), np.zeros(len(a), bool))

    better = map_stream(met, compare, EDGES, rows=65_536)
    return merged(graph.withColumn("fresh", F.lit(False)).union(better), tasks)


def verified(vectors: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v, n_u, n_v), u < v, among the listed pairs of vectors that aren't both dense, by exact cosine."""
    pairs = graph.where("not dense").select(F.least("id", "nbr").alias("u"), F.greatest("id", "nbr").alias("v")).distinct()
    ends = [vectors.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("vec").alias(f"vec_{k}")) for k in "uv"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        sizes = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes):
            own = np.flatnonzero(sizes == dims)
            x, y = (unit(matrix(batch.column(k).take(pa.array(own)))) for k in (4, 5))
            keep[own] = np.einsum("ij,ij->i", x, y) >= threshold
        at = pa.array(np.flatnonzero(keep))
        return pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in range(4)], ["u", "v", "n_u", "n_v"])

    both = pairs.join(ends[0], "u").join(ends[1], "v").select("u", "v", "n_u", "n_v", "vec_u", "vec_v")
    return cut(map_batches(both, run, "u long, v long, n_u long, n_v long", rows=4096))


def dense_groups(graph: DataFrame) -> DataFrame:
    """id and root of dense vectors: what their nearest two join. It only says which go into one block."""
    own = graph.where("dense").select(F.col("id").alias("u"), F.col("nbr").alias("v"))
    return own.select(F.col("u").alias("id")).distinct().join(connected_components(own).select(F.col("node").alias("id"), "root"), "id")


def blocks_of(members: DataFrame, rows: int) -> DataFrame:
    """Blocks (p, block, chunk, centre, radius, ids, n, vecs) of about `rows` members (id, p, n, vec, root) of one root, dealt by hash, however the members are
    partitioned. The radius is an angle. A chunk holds about CHUNK blocks, of one large root or of several small ones."""
    kind = blob_type(members)

    def run(key, held):
        ids, n = held.column("id").to_numpy(), held.column("n").to_numpy()
        raw = matrix(held.column("vec").combine_chunks())
        x = unit(raw)
        centre = x.mean(axis=0)
        centre = centre / np.linalg.norm(centre) if np.linalg.norm(centre) > 1e-9 else x[0]
        radius = float(np.arccos(np.clip(x @ centre, -1, 1)).max())
        out = ([key[0].as_py()], [key[3].as_py()], [centre.tolist()], [radius], [ids.tobytes()], [n.tobytes()], [raw.astype(kind).tobytes()])
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["p", "chunk", "centre", "radius", "ids", "n", "vecs"])

    sizes = cut(members.groupBy("p", "root").agg(F.ceil(F.count("*") / rows).alias("blocks")))
    chunks = sizes.groupBy("p").agg(F.ceil(F.sum("blocks") / CHUNK).alias("chunks"))
    laid = members.join(sizes.join(chunks, "p"), ["p", "root"]).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = F.xxhash64("p", "root", F.floor(F.col("at") / CHUNK))
    laid = laid.withColumn("chunk", F.when(F.col("blocks") > CHUNK, own).otherwise(F.xxhash64("p", F.pmod(F.xxhash64("root"), F.col("chunks")))))
    made = laid.groupBy("p", "root", "at", "chunk").applyInArrow(run, "p long, chunk long, centre array<double>, radius double, ids binary, n binary, vecs binary")
    return cut(made.withColumn("block", F.monotonically_increasing_id()))


def blob_type(vectors: DataFrame) -> str:
    return "<f4" if vectors.schema["vec"].dataType.simpleString() == "array<float>" else "<f8"


def block_pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, a_chunk, b_chunk, whole) of pairs of blocks of one label, a <= b, that can have links; whole: all their pairs are links. Only centres move."""
    angle = float(np.arccos(np.clip(threshold, -1, 1)))
    sizes = blocks.groupBy("p").agg(F.ceil(F.count("*") / CENTRES).alias("decks"))
    centres = blocks.select("p", "block", "chunk", "centre", "radius").join(cut(sizes), "p").withColumn("deck", F.pmod(F.xxhash64("block"), F.col("decks")))
    dealt = centres.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("decks") - 1))).select("p", F.least("deck", "other").alias("i"), F.greatest("deck", "other").alias("j"), "deck", "block", "chunk", "radius", "centre")

    def run(key, held):
        i, j = key[1].as_py(), key[2].as_py()
        deck, block, chunk, radius = (held.column(k).to_numpy() for k in ("deck", "block", "chunk", "radius"))
        x = matrix(held.column("centre").combine_chunks())
        out = []
        left, right = np.flatnonzero(deck == i), np.flatnonzero(deck == j)
        for k in range(0, len(left), 512):
            own = left[k : k + 512]
            apart = np.arccos(np.clip(x[own] @ x[right].T, -1, 1))
            both = radius[own][:, None] + radius[right][None, :]
            u, v = np.nonzero((apart - both <= angle + 1e-6) & ((block[own][:, None] <= block[right][None, :]) if i == j else True))
            whole = apart[u, v] + both[u, v] <= angle - 1e-6
            a, b = own[u], right[v]
            turned = block[a] > block[b]
            a, b = np.where(turned, b, a), np.where(turned, a, b)
            out.append((block[a], block[b], chunk[a], chunk[b], whole))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, bool)]
        return pa.table(dict(zip(("a", "b", "a_chunk", "b_chunk", "whole"), columns, strict=True)))

    return cut(dealt.groupBy("p", "i", "j").applyInArrow(run, "a long, b long, a_chunk long, b_chunk long, whole boolean"))


def compare_dense(members: DataFrame, threshold: float, rows: int = BLOCK) -> DataFrame:
    """id, linked (the sum of n over those linked with it) and star (an id of the same component), for members (id, p, n, vec, root); an id
    may have several rows. All pairs of a label count."""
    kind, blocks = blob_type(members), blocks_of(members, rows)
    pairs = block_pairs(blocks, threshold)

    # Pairs of blocks in which all are linked: counts and stars without products.
    whole = pairs.where("whole")
    facts = map_batches(blocks.select("block", "ids", "n"), lambda b: pa.RecordBatch.from_pydict({"block": b.column(0), "total": pa.array([int(np.frombuffer(x, np.int64).sum()) for x in b.column(2).to_pylist()], pa.int64()), "least": pa.array([int(np.frombuffer(x, np.int64).min()) for x in b.column(1).to_pylist()], pa.int64())}), "block long, total long, least long", rows=64)
    facts = cut(facts)
    sides = whole.select(F.col("a").alias("block"), F.col("b").alias("with")).union(whole.where("a <> b").select(F.col("b").alias("block"), F.col("a").alias("with")))
    added = sides.join(facts.withColumnRenamed("block", "with"), "with").groupBy("block").agg(F.sum("total").alias("total"), F.min("least").alias("star"), F.max(F.col("block") == F.col("with")).alias("itself"))

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for ids, n, total, star, itself in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
            out.append((ids, total - n * itself, np.full(len(ids), star)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["id", "linked", "star"])

    ends = [facts.select(F.col("block").alias(k), F.col("least").alias(f"least_{k}")) for k in "ab"]
    joined = whole.where("a <> b").join(ends[0], "a").join(ends[1], "b").select(F.col("least_a").alias("id"), F.lit(0).cast("long").alias("linked"), F.col("least_b").alias("star"))
    given = map_batches(blocks.join(added, "block").select("ids", "n", "total", "star", "itself"), spread, "id long, linked long, star long", rows=64)

    # The others are multiplied, a pair of chunks in a task.
    part = pairs.where("not whole")
    chunks = part.select("a_chunk", "b_chunk").distinct()
    sent = chunks.select("a_chunk", "b_chunk", F.explode(F.array_distinct(F.array("a_chunk", "b_chunk"))).alias("chunk")).join(blocks.select("chunk", "block", "ids", "n", "vecs"), "chunk")

    def multiply(key, wanted, held):
        at = {b: k for k, b in enumerate(held.column("block").to_pylist())}
        raw = [(np.frombuffer(i.as_py(), np.int64), np.frombuffer(n.as_py(), np.int64), v) for i, n, v in zip(held.column("ids"), held.column("n"), held.column("vecs"), strict=True)]

        def vectors_of(k: int) -> np.ndarray:
            return unit(np.frombuffer(raw[k][2].as_py(), kind).astype(np.float64).reshape(len(raw[k][0]), -1))

        linked = {k: np.zeros(len(r[0]), np.int64) for k, r in enumerate(raw)}
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        last, x = -1, None
        for a, b in sorted(zip(wanted.column("a").to_pylist(), wanted.column("b").to_pylist(), strict=True)):
            i, j = at[a], at[b]
            if last != i:
                last, x = i, vectors_of(i)
            y = x if i == j else vectors_of(j)
            near = x @ y.T >= threshold
            if i == j:
                np.fill_diagonal(near, False)
            p, q = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            if not len(p):
                continue
            near = near[np.ix_(p, q)]
            (a_ids, a_n, _), (b_ids, b_n, _) = raw[i], raw[j]
            weights = near.astype(np.float64)
            linked[i][p] += np.rint(weights @ b_n[q]).astype(np.int64)
            if i != j:
                linked[j][q] += np.rint(weights.T @ a_n[p]).astype(np.int64)
            u, v = np.nonzero(near)
            ids = a_ids[p] if i == j else np.concatenate([a_ids[p], b_ids[q]])
            stars.append((ids, ids[local_labels(len(ids), u, v if i == j else v + len(p))]))
        ids = np.concatenate([np.zeros(0, np.int64), *(raw[k][0] for k in linked), *(s[0] for s in stars)])
        sums = np.concatenate([np.zeros(0, np.int64), *linked.values(), *(np.zeros(len(s[0]), np.int64) for s in stars)])
        star = np.concatenate([np.zeros(0, np.int64), *(raw[k][0] for k in linked), *(s[1] for s in stars)])
        some = (sums > 0) | (star != ids)
        return pa.table({"id": ids[some], "linked": sums[some], "star": star[some]})

    asked = part.select("a_chunk", "b_chunk", "a", "b")
    counted = asked.groupBy("a_chunk", "b_chunk").cogroup(sent.select(F.col("a_chunk").alias("i"), F.col("b_chunk").alias("j"), "block", "ids", "n", "vecs").groupBy("i", "j")).applyInArrow(multiply, "id long, linked long, star long")
    return cut(given.union(joined).union(counted))


def audited(vectors: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The mean share of true links that were found, over drawn vectors that have some; 1 if none has."""
    rows = vectors.count()
    draws, share = AUDIT_FIRST, 0.0
    while True:
        share = min(1.0, draws / max(rows, 1))
        drawn = vectors.where(F.xxhash64("id", F.lit(3)) < F.lit(int(share * (1 << 64)) - (1 << 63)) if share < 1 else F.lit(True)).select("id", "p", "n", "vec").toArrow()
        queries = [(drawn.take(pa.array(own)).column("id").to_numpy(), drawn.take(pa.array(own)).column("p").to_numpy(), x) for own, x in by_size(drawn.column("vec").combine_chunks())] if drawn.num_rows else []
        # At most about AUDIT_MOST vectors.
        shared = vectors.sparkSession.sparkContext.broadcast(queries)

        def count(batches, shared=shared):
            total: dict[int, int] = {}
            for batch in batches:
                p, n, ids = (batch.column(k).to_numpy() for k in range(3))
                for own, x in by_size(batch.column(3)):
                    for q_ids, q_p, q in shared.value:
                        if q.shape[1] == x.shape[1]:
                            near = (q @ x.T >= threshold) & (q_p[:, None] == p[own][None, :]) & (q_ids[:, None] != ids[own][None, :])
                            for k in np.flatnonzero(near.any(axis=1)).tolist():
                                total[int(q_ids[k])] = total.get(int(q_ids[k]), 0) + int(n[own][near[k]].sum())
            yield pa.RecordBatch.from_pydict({"id": pa.array(list(total), pa.int64()), "there": pa.array(list(total.values()), pa.int64())})

        there = map_stream(vectors.select("p", "n", "id", "vec"), count, "id long, there long", rows=4096).groupBy("id").agg(F.sum("there").alias("there"))
        row = there.join(counts, "id", "left").agg(F.count("*").alias("linked"), F.avg(F.coalesce("linked", F.lit(0)) / F.col("there")).alias("recall")).first()
        if row["linked"] >= AUDIT_LINKED or share >= 1 or draws >= AUDIT_MOST:
            return 1.0 if row["recall"] is None else float(row["recall"])
        draws *= 8


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of embeddings (vec_id, embedding, label)."""
    # Single-precision vectors stay so in shuffles, at half the size; every product is in double.
    kept_as = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    frame = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kept_as).alias("vec"), F.col("label"))
    usable = F.expr("vec_id is not null and label is not null and vec is not null and size(vec) > 0 and forall(vec, x -> coalesce(not isnan(x) and abs(x) < double('infinity'), false)) and exists(vec, x -> x <> 0)")
    frame = frame.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("part", F.concat_ws(":", F.size("vec"), F.col("label").cast("string")))
    good = frame.where("usable").withColumn("k1", F.xxhash64("vec")).withColumn("k2", F.xxhash64("vec", F.lit(1)))
    keys = ["part", "k1", "k2"]
    counted = good.select(*keys, "vec_id").distinct().groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    sizes = cut(counted.groupBy("part").agg(F.count("*").alias("size")).withColumn("p", F.monotonically_increasing_id()).withColumn("levels", F.greatest(F.lit(0), F.least(F.lit(DEEPEST), F.ceil(F.log2(F.col("size") / LEAF)))).cast("long")))
    vectors = good.groupBy(*keys).agg(F.first("vec").alias("vec")).join(counted, keys).join(sizes.select("part", "p", "levels"), "part")
    vectors = cut(vectors.withColumn("id", F.monotonically_increasing_id()).select("id", *keys, "p", "levels", "rep", "n", "vec"))
    rows = vectors.count()
    tasks, graph, recall, signs = tasks_for(vectors, rows), None, 0.0, cut(signed(vectors))
    for seed in range(STARTS):
        fresh = start(vectors, threshold, seed, rows)
        graph = fresh if graph is None else merged(graph.union(fresh), tasks)
        for k in range(ROUNDS):
            graph = refine(signs, graph, threshold, 100 * seed + k, tasks)
            if graph.where("fresh and not dense").isEmpty():
                break
        links = verified(vectors, graph, threshold)
        stars = links.select("u", "v")
        both = links.select(F.col("u").alias("id"), F.col("n_v").alias("linked")).union(links.select(F.col("v").alias("id"), F.col("n_u").alias("linked")))
        groups = dense_groups(graph)
        if not groups.isEmpty():
            dense = compare_dense(groups.join(vectors.select("id", "p", "n", "vec"), "id"), threshold)
            both = both.union(dense.select("id", "linked"))
            stars = stars.union(dense.where("id <> star").select(F.col("id").alias("u"), F.col("star").alias("v")))
        counts = cut(both.groupBy("id").agg(F.sum("linked").alias("linked")))
        recall = audited(vectors, counts, threshold)
        if recall >= AUDIT_RECALL:
            break
    else:
        raise RuntimeError(f"the neighbour graph holds only {recall:.3f} of the audited links after {STARTS} starts")
    roots = connected_components(stars).select(F.col("node").alias("id"), "root")
    solved = vectors.select("id", *keys, "rep", "n").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = solved.groupBy("root").agg(F.min("rep").alias("component_id"))
    solved = solved.join(least, "root").select(*keys, (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(solved, keys).select("vec_id", "n_links", "component_id")
    alone = frame.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
