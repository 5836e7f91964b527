"""Quality by ordinal cumulative-link regression on graded ratings over hashed text.

All grades share one weight for each hashed feature of a token; ordered thresholds cut the sum into grades, so that
P(grade > g) = logistic(sum - threshold[g]). From these come the expected grade and the tail probability used for selection.
Grades follow from `labels`: 0 for quality 0, 1 for quality 1 that is toxic, 2 for other quality 1.

A token's features are itself, its form (letters, digits and marks as classes) and whether it repeats the token before;
the sum is over means, so a text's length does not matter. The fit reads a bounded, hashed sample; the driver holds eight bytes for each distinct
feature of a sampled document.

Nulls: a null text has only the constant feature; a null doc_id stays null; labels without quality are left out. Without labelled rows, as in
empty tables, all weights are zero and the tail probability is a half. Texts are read whole, however long. Repeated rows of docs are
scored each, and count as often in the fit; of a doc_id with several labels the highest grade counts. A tail of exactly a half is kept.
Columns named expected_grade, tail or kept are replaced.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembering, hashed_share, map_batches, per_worker, texts_of

#: Hash buckets; labelled documents of each grade that the fit reads (expected number); grades.
BUCKETS, FIT_DOCS, GRADES = 1 << 16, 2500, 3
DENSE = 3
WORDS = re.compile(r"\S+")
RUNS = re.compile(r"a+|A+|9+")


def form(token: str) -> str:
    """Classes of the token's characters, runs shortened."""
    return RUNS.sub(lambda m: m[0][0], "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))[:12]


def buckets(token: str) -> tuple[int, int]:
    return DENSE + zlib.crc32(token.lower().encode()) % BUCKETS, DENSE + zlib.crc32(b"\0" + form(token).encode()) % BUCKETS


class Hashing:
    def __init__(self):
        self.of = Remembering(buckets)

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and values: the constant, shares of repeated tokens and of repeated kinds, then means of hashed features."""
        tokens = text.split()
        if not tokens:
            return np.array([0]), np.array([1.0])
        at, n = np.unique(np.array(list(map(self.of.__getitem__, tokens))).ravel(), return_counts=True)
        same = sum(map(eq, tokens, tokens[1:])) / len(tokens)
        return np.concatenate([[0, 1, 2], at]), np.concatenate([[1.0, same, 1 - len(set(tokens)) / len(tokens)], n / len(tokens)])


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, rounds: int = 30, rate: float = 0.5, penalty: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds by adaptive gradient steps on the cumulative-link likelihood, in blocks of rows in a fixed order."""
    w, seen = np.zeros(DENSE + BUCKETS), np.full(DENSE + BUCKETS, 1e-6)
    cuts = np.linspace(-1.0, 1.0, GRADES - 1)
    if not len(rows):
        return w, np.zeros(GRADES - 1)
    order, cut_seen = np.random.default_rng(0), np.full(GRADES - 1, 1e-6)
    share = np.bincount(grades, minlength=GRADES)
    weight = len(grades) / (np.count_nonzero(share) * np.maximum(share, 1))
    for _ in range(rounds):
        for block in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 64)):
            at, value = (np.concatenate([rows[k][j] for k in block]) for j in (0, 1))
            row = np.repeat(np.arange(len(block)), [len(rows[k][0]) for k in block])
            total = np.bincount(row, w[at] * value, minlength=len(block))
            y = grades[block]
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            low, high = 1 / (1 + np.exp(np.clip(total - edges[y], -30, 30))), 1 / (1 + np.exp(np.clip(total - edges[y + 1], -30, 30)))
            p = np.maximum(high - low, 1e-9)
            dlow, dhigh = low * (1 - low), high * (1 - high)
            push = (dhigh - dlow) / p * weight[y]  # of the negative log likelihood, by the sum
            slope = np.bincount(at, push[row] * value, minlength=len(w)) / len(block)
            touched = np.flatnonzero(slope)
            g = slope[touched] + penalty * w[touched]
            seen[touched] += g * g
            w[touched] -= rate * g / np.sqrt(seen[touched])
            g = np.zeros(GRADES - 1)
            for j in range(GRADES - 1):
                g[j] = (np.where(y == j, -dhigh / p, 0) + np.where(y == j + 1, dlow / p, 0)) @ weight[y] / len(block)
            cut_seen += g * g
            cuts = np.sort(cuts - rate * g / np.sqrt(cut_seen))
    return w, cuts


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from a bounded, hashed sample of the labelled rows of docs."""
    graded = labels.where("quality in (0, 1) and doc_id is not null").where(F.lit(True) if learn is None else learn)
    graded = graded.groupBy("doc_id").agg(F.max(F.expr("case when quality = 0 then 0 when toxic = 1 then 1 else 2 end")).alias("y"))
    chosen = None
    for row in graded.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect():
        part = hashed_share(graded.where(F.col("y") == row["y"]), "doc_id", fit_docs / row["n"])
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return fit_ordinal([], np.zeros(0, int))
    # At most about GRADES * fit_docs ids: a broadcast of bounded size.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashing = per_worker("quality features", Hashing)
        found = [hashing.features(x) for x in texts_of(batch)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "at": pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())), "value": pa.array([v.astype(np.float32) for _, v in found], pa.list_(pa.float32())), "y": batch.column(2)})

    rows = map_batches(sample, describe, "doc_id long, at array<int>, value array<float>, y int").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    at, value, y = (rows.column(k).combine_chunks() for k in ("at", "value", "y"))
    return fit_ordinal([(at[int(k)].values.to_numpy(), value[int(k)].values.to_numpy()) for k in order], y.to_numpy()[order])


def classify(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs (with a column text) with expected_grade (0 to 2), tail (the probability of a grade above 0) and kept (a tail of at least a half)."""
    plain = docs.drop("expected_grade", "tail", "kept")
    shared, key = docs.sparkSession.sparkContext.broadcast(model), ("quality", hashlib.sha256(model[0].tobytes() + model[1].tobytes()).hexdigest())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, cuts = shared.value

        def weigh(token: str) -> float:
            a, b = buckets(token)
            return float(weights[a] + weights[b])

        of = per_worker(key, lambda: Remembering(weigh)).__getitem__
        totals = []
        for text in texts_of(batch):
            tokens = text.split()
            total = weights[0]
            if tokens:
                total += weights[1] * sum(map(eq, tokens, tokens[1:])) / len(tokens) + weights[2] * (1 - len(set(tokens)) / len(tokens)) + sum(map(of, tokens)) / len(tokens)
            totals.append(total)
        above = 1 / (1 + np.exp(np.clip(cuts[None, :] - np.array(totals).reshape(-1, 1), -30, 30)))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(axis=1)), pa.array(above[:, 0])], [*batch.schema.names, "expected_grade", "tail"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", expected_grade double, tail double"
    return map_batches(plain, run, schema).withColumn("kept", F.col("tail") >= 0.5)
