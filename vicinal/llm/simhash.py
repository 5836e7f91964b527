"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 bits; equal ones are one row from the start. The self-join walks pairs of trie nodes down together,
adds up differing bits and drops a pair as soon as it has more than allowed. Tries are spread over tasks by the pigeonhole
principle: the 64 bits are dealt into m blocks, and two fingerprints that differ in at most b bits agree on some m - b of them,
so there is one table of tries for each choice of m - b blocks, and the chosen bits are a trie's first levels, where no bit
may differ. m follows from the number of fingerprints. A trie with very many fingerprints is dealt again over tasks by pairs
of subtrees that can still meet the budget. A task keeps labels of what is already linked and drops pairs of
nodes that lie wholly in one component, so that a group of near copies costs about as many steps as it has members.

Tasks return stars, not pairs; components are made from these on executors.

Nulls: a null text has no words, so the fingerprint zero, linked like any other; rows with a null doc_id take part and have
the component of the others; a component with only null ids has a null component_id. An empty table gives an empty result. Very long texts
are hashed whole, in slices. Repeated rows and repeated ids have a row each. Bits set in exactly half of the shingles are 0. Only
doc_id, text and the key are read, so other columns cannot clash.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, groups_of, map_batches, map_stream, texts_of
from .components import connected_components, local_labels, stars

BITS, BUDGET, SHINGLE, SEED = 64, 4, 4, 42
#: A trie with more fingerprints than this, or than a 4096th of all, is dealt over tasks by pairs of subtrees.
HOT_TRIE, HOT_LEVELS = 20_000, 5
#: Node pairs walked at once.
FRONT = 1 << 18


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(line, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends + 1 - sizes).tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    bits = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        part = np.array(hashes[k : k + 4096], ">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """doc_id and fingerprint (as a signed 64-bit integer) of every row of docs (columns doc_id, text), and the string column `key`, if given."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(x, shingle) for x in texts_of(batch)], np.uint64)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "fp": pa.array(prints.view(np.int64))} | ({key: batch.column(2)} if key else {}))

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", *[key] * bool(key)), run, "doc_id long, fp long" + (f", {key} string" if key else ""))


def layout(rows: int, budget: int = BUDGET) -> list[np.ndarray]:
    """For each table, the order in which its tries take the bits (0 is the highest), after the number of chosen ones."""
    m = budget + (1 if rows <= 1 << 24 else 2 if rows <= 1 << 32 else 3)
    blocks = np.array_split(np.arange(BITS), m)
    tables = []
    for chosen in combinations(range(m), m - budget):
        first = np.concatenate([blocks[k] for k in chosen])
        tables.append(np.concatenate([[len(first)], first, *[blocks[k] for k in range(m) if k not in chosen]]))
    return tables


def permuted(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Fingerprints with their bits in the given order, from the highest."""
    out = np.zeros_like(prints)
    k = 0
    while k < BITS:  # runs of neighbouring bits move together
        n = 1
        while k + n < BITS and order[k + n] == order[k] + n:
            n += 1
        mask = np.uint64((1 << n) - 1)
        out |= ((prints >> np.uint64(BITS - int(order[k]) - n)) & mask) << np.uint64(BITS - k - n)
        k += n
    return out


def trie_links(keys: np.ndarray, groups: list[tuple[int, int, int, int]], deepest: np.ndarray, labels: np.ndarray, budget: int) -> np.ndarray:
    """Labels of the components of keys. Each group (lo, hi, level, middle) is a trie over sorted keys[lo:hi] whose bits above level agree; with a middle, its two halves are only compared with each other and have `deepest` bits differing so far."""
    n = len(keys)
    roots = np.array([(lo, hi, lo, hi, level, 0) if mid < 0 else (lo, mid, mid, hi, level, d) for (lo, hi, level, mid), d in zip(groups, deepest, strict=True)], np.int64).reshape(-1, 6)
    ones: dict[int, np.ndarray] = {}
    stack = [(int(level), roots[roots[:, 4] == level][:, [0, 1, 2, 3, 5]]) for level in np.unique(roots[:, 4])]
    changes = np.arange(n)
    while stack:
        level, front = stack.pop()
        if len(front) > FRONT:
            cuts = range(0, len(front), FRONT)
            stack += [(level, front[k : k + FRONT]) for k in cuts]
            continue
        alo, ahi, blo, bhi, d = front.T
        single = (ahi - alo == 1) & (bhi - blo == 1)
        one_part = (labels[alo] == labels[blo]) & (changes[ahi - 1] == changes[alo]) & (changes[bhi - 1] == changes[blo])
        near = single & ~one_part
        if near.any():
            u, v = alo[near], blo[near]
            linked = np.bitwise_count(keys[u] ^ keys[v]) <= budget
            if linked.any():
                labels = local_labels(n, u[linked], v[linked], labels)
                changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        front = front[~single & ~one_part]
        if not len(front) or level >= BITS:
            continue
        if level not in ones:
            ones[level] = np.concatenate([[0], np.cumsum((keys >> np.uint64(BITS - 1 - level)) & np.uint64(1))]).astype(np.int64)
        alo, ahi, blo, bhi, d = front.T
        amid, bmid = ahi - (ones[level][ahi] - ones[level][alo]), bhi - (ones[level][bhi] - ones[level][blo])
        own = alo == blo
        parts = [
            np.stack([alo, amid, bmid, bhi, d + 1], 1),
            np.stack([amid, ahi, blo, bmid, d + 1], 1)[~own],
            np.stack([alo, amid, blo, bmid, d], 1),
            np.stack([amid, ahi, bmid, bhi, d], 1),
        ]
        fresh = np.concatenate(parts)
        alo, ahi, blo, bhi, d = fresh.T
        keep = (ahi > alo) & (bhi > blo) & (d <= budget) & ~((alo == blo) & (ahi - alo == 1))
        stack.append((level + 1, fresh[keep]))
    return labels


def links(prints: DataFrame, rows: int, budget: int = BUDGET, hot_trie: int = HOT_TRIE) -> DataFrame:
    """Stars (u, v) that link the distinct fingerprints (column fp) within the budget as all pairs would."""
    tables = layout(rows, budget)
    pairs = [(s, t) for s in range(1 << HOT_LEVELS) for t in range(s, 1 << HOT_LEVELS) if (s ^ t).bit_count() <= budget]
    tasks_of = [[k for k, (s, t) in enumerate(pairs) if x in (s, t)] for x in range(1 << HOT_LEVELS)]

    def keys_of(values: np.ndarray):
        for k, order in enumerate(tables):
            bits = permuted(values, order[1:])
            yield k, bits, (np.int64(k) << 56) | (bits >> np.uint64(BITS - int(order[0]))).astype(np.int64)

    def dealt(hot: frozenset[int]):
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = np.asarray(batch.column(0)).view(np.uint64)
            tries, parts, out = [], [], []
            for k, bits, trie in keys_of(values):
                is_hot = np.isin(trie, hot_array) if hot else np.zeros(len(trie), bool)
                tries.append(trie[~is_hot])
                parts.append(np.full(len(tries[-1]), -1, np.int32))
                out.append(values[~is_hot])
                if is_hot.any():
                    level = int(tables[k][0])
                    subs = ((bits[is_hot] >> np.uint64(BITS - level - HOT_LEVELS)) & np.uint64((1 << HOT_LEVELS) - 1)).astype(int)
                    for x, trie_of, value in zip(subs, trie[is_hot], values[is_hot], strict=True):
                        tries.append(np.full(len(tasks_of[x]), trie_of))
                        parts.append(np.array(tasks_of[x], np.int32))
                        out.append(np.full(len(tasks_of[x]), value))
            return pa.RecordBatch.from_pydict({"trie": np.concatenate(tries).astype(np.int64), "part": np.concatenate(parts), "fp": np.concatenate(out).view(np.int64)})

        hot_array = np.array(sorted(hot), np.int64)
        return run

    def join(batches):
        for held in groups_of(batches, 2, 1 << 18):
            yield from join_tries(*(held.column(k).to_numpy() for k in range(3)))

    def join_tries(trie, part, fp):
        values, at = np.unique(fp.view(np.uint64), return_inverse=True)
        labels = np.arange(len(values))
        for k, order in enumerate(tables):
            mine = trie >> 56 == k
            if not mine.any():
                continue
            level = int(order[0])
            bits = permuted(values[at[mine]], order[1:])
            by = np.lexsort((bits, part[mine], trie[mine]))
            bits, own_part, own_trie, node = bits[by], part[mine][by], trie[mine][by], at[mine][by]
            edge = np.flatnonzero((np.diff(own_trie) != 0) | (np.diff(own_part) != 0)) + 1
            groups, differing = [], []
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(bits)], strict=True):
                if hi - lo < 2:
                    continue
                if own_part[lo] < 0 or pairs[own_part[lo]][0] == pairs[own_part[lo]][1]:
                    groups.append((lo, hi, level, -1))
                    differing.append(0)
                else:
                    s, t = pairs[own_part[lo]]
                    sub = (bits[lo:hi] >> np.uint64(BITS - level - HOT_LEVELS)) & np.uint64((1 << HOT_LEVELS) - 1)
                    mid = lo + int(np.searchsorted(sub, np.uint64(t)))
                    if lo < mid < hi:
                        groups.append((lo, hi, level + HOT_LEVELS, mid))
                        differing.append((s ^ t).bit_count())
            if groups:
                found = trie_links(bits, groups, np.array(differing), np.arange(len(bits)), budget)
                far = found != np.arange(len(bits))
                labels = local_labels(len(values), node[far], node[found[far]], labels)
        far = labels != np.arange(len(values))
        if far.any():
            yield pa.RecordBatch.from_pydict({"u": values[far].view(np.int64), "v": values[labels[far]].view(np.int64)})

    schema = "trie long, part int, fp long"
    counted = map_batches(prints.select("fp"), dealt(frozenset()), schema, rows=16_384).groupBy("trie").count()
    limit = max(hot_trie, rows * len(tables) // 4096)  # so there are at most 4096 hot tries
    hot = frozenset(r["trie"] for r in counted.where(F.col("count") > limit).select("trie").collect())
    spread = map_batches(prints.select("fp"), dealt(hot), schema, rows=16_384).repartition("trie", "part").sortWithinPartitions("trie", "part")
    return map_stream(spread, lambda batches: stars(join(batches)), "u long, v long", rows=65_536)


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE, hot_trie: int = HOT_TRIE, key: str | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of the component), root (a fingerprint of the component, never null), and `key`, if given, for every row of docs (columns doc_id, text, and key)."""
    prints = cut(fingerprints(docs, shingle, key))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    components = connected_components(links(distinct, distinct.count(), budget, hot_trie), contract=False)
    rooted = distinct.join(components, distinct["fp"] == components["node"], "left").select("fp", "rep", "root")
    linked = rooted.where("root is not null")
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    final = linked.join(least, "root").select("fp", F.col("least").alias("component_id"), "root").union(rooted.where("root is null").select("fp", F.col("rep").alias("component_id"), F.col("fp").alias("root")))
    return prints.join(final, "fp").select("doc_id", "fp", "component_id", "root", *[key] * bool(key))
